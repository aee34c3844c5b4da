"""Zip members, batches, versions and file digests."""

import csv
import io
import random
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from loomset.operators import clean
from loomset.sources import batches, files, versions, zipped


def archive(path, **members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name.replace("_csv", ".csv").replace("_txt", ".txt"), text)
    return str(path)


def test_a_zip_member_is_read_in_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(zipped, "BATCH", 7)
    rng = random.Random(1)
    rows = [[str(k), rng.choice(["", "NA", "null", 'says "no"', "line\nend", "a,b", "\r\n", "é漢"]), "x" * rng.randint(0, 50)] for k in range(100)]
    out = io.StringIO()
    csv.writer(out).writerows([["id", "some text", "x"], *rows])
    path = archive(tmp_path / "a.zip", rows_csv="﻿" + out.getvalue(), readme_txt="no")
    found = zipped.read_csv(spark, path, ["id", "some text"])
    assert found.columns == ["id", "some text", "x"] and sorted([list(r) for r in found.collect()], key=lambda r: int(r[0])) == rows
    assert zipped.read_csv(spark, archive(tmp_path / "b.zip", a_csv="a,b\n1\n\n2,3\n")).collect() == [("1", ""), ("2", "3")]
    assert zipped.read_csv(spark, archive(tmp_path / "c.zip", a_csv="a,b\n")).count() == 0


def test_zip_archives_that_will_not_do(spark, tmp_path):
    for name, members in {"none": {"a_txt": "x"}, "two": {"a_csv": "a\n1", "b_csv": "a\n1"}, "empty": {"a_csv": ""}, "twice": {"a_csv": "a,a\n"}}.items():
        with pytest.raises(ValueError):
            zipped.read_csv(spark, archive(tmp_path / f"{name}.zip", **members))
    with pytest.raises(ValueError, match="missing columns: b"):
        zipped.read_csv(spark, archive(tmp_path / "m.zip", a_csv="a\n1"), ["a", "b"])
    with pytest.raises(Exception, match="2 fields"):
        zipped.read_csv(spark, archive(tmp_path / "l.zip", a_csv="a\n1,2")).collect()


def test_a_large_zip_member_leaves_the_task_in_batches(tmp_path):
    """The member is never held whole: the reader takes what it needs of the stream."""
    path = archive(tmp_path / "big.zip", a_csv="id,text\n" + "".join(f"{k},{'word ' * 200}\n" for k in range(20_000)))
    content = open(path, "rb").read()
    import tracemalloc

    tracemalloc.start()
    n = sum(1 for _ in zipped._records(content))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 20_001 and peak < 4 * len(content) + 2_000_000 < 20_000_000


def some_records(spark, n=60):
    rows = [(str(k % 40) if k % 13 else (" " if k % 2 else None), k, f"text {k % 11}") for k in range(n)]
    return spark.createDataFrame(rows, "id string, line int, body string").withColumn("sha", F.sha2("body", 256))


def test_batches_equal_one_load(spark, tmp_path):
    frame, folder = some_records(spark), str(tmp_path / "t")
    told = [batches.append(frame.filter(f"line >= {a} AND line < {b}"), folder, f"b{a}", "id", "line", "sha") for a, b in ((0, 20), (20, 45), (45, 60))]
    whole = clean.keep_first(frame.filter("trim(id) <> ''"), "id", "line")
    assert sorted(map(tuple, batches.read(spark, folder).collect())) == sorted(map(tuple, whole.select(*frame.columns).collect()))
    assert sum(m["written_rows"] for m in told) == whole.count() and [m["number"] for m in batches.loaded(spark, folder)] == [0, 1, 2]
    assert told[2]["seen_before"] > 0 and told[1]["texts_there_already"] > 0 and told[0]["seen_before"] == 0
    # again: nothing is added
    assert batches.append(frame, folder, "b20", "id", "line", "sha") == told[1] and batches.read(spark, folder).count() == whole.count()
    none = batches.append(frame.filter("line < 20"), folder, "late", "id", "line")
    assert none["written_rows"] == 0 and batches.read(spark, folder).count() == whole.count()
    with pytest.raises(ValueError):
        batches.append(frame, folder, "../x", "id", "line")


def test_a_batch_that_dies_leaves_no_trace(spark, tmp_path, monkeypatch):
    frame, folder = some_records(spark), str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        batches.read(spark, folder)
    batches.append(frame.filter("line < 20"), folder, "one", "id", "line")
    before = sorted(map(tuple, batches.read(spark, folder).collect()))
    real = files.replace_small
    monkeypatch.setattr(files, "replace_small", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        batches.append(frame, folder, "two", "id", "line")
    assert sorted(map(tuple, batches.read(spark, folder).collect())) == before and len(batches.loaded(spark, folder)) == 1
    monkeypatch.setattr(files, "replace_small", real)
    batches.append(frame, folder, "two", "id", "line")
    assert batches.read(spark, folder).count() == clean.keep_first(frame.filter("trim(id) <> ''"), "id", "line").count()


def test_versions_are_whole(spark, tmp_path):
    folder = str(tmp_path / "v")
    with pytest.raises(FileNotFoundError):
        versions.read(spark, folder)
    one = versions.write(spark.range(10), folder)
    held = versions.read(spark, folder)
    two = versions.write(spark.range(25), folder)
    assert held.count() == 10 and versions.read(spark, folder, verify=True).count() == 25 == two["rows"]
    with pytest.raises(ValueError, match="columns change"):
        versions.write(spark.range(3).withColumn("x", F.lit(1)), folder)

    def refuse(frame):
        raise ValueError("too few")

    with pytest.raises(ValueError, match="too few"):
        versions.write(spark.range(1), folder, check=refuse)
    assert versions.current(spark, folder) == two and versions.prune(spark, folder) == [one["version"]]
    assert versions.write(spark.range(3).withColumn("x", F.lit(1)), folder, same_schema=False)["rows"] == 3


def test_readers_during_swaps_see_one_version(spark, tmp_path):
    folder = str(tmp_path / "v")
    versions.write(spark.range(100).selectExpr("id", "0 AS n"), folder)
    seen, stop = [], threading.Event()

    def reader():
        while not stop.is_set():
            rows = versions.read(spark, folder).selectExpr("count(*) AS c", "count(DISTINCT n) AS d").first()
            seen.append((rows["c"], rows["d"]))

    thread = threading.Thread(target=reader)
    thread.start()
    for k in range(1, 4):
        versions.write(spark.range(100).selectExpr("id", f"{k} AS n"), folder)
    stop.set()
    thread.join()
    assert seen and set(seen) == {(100, 1)}


def test_a_pointer_is_there_and_whole_at_any_moment(spark, tmp_path):
    path = str(tmp_path / "_pointer.json")
    files.replace_small(spark, path, "0" * 50)
    seen, faults, stop = set(), [], threading.Event()

    def reader():
        while not stop.is_set():
            try:
                assert files.exists(spark, path)
                seen.add(files.read_small(spark, path))
            except BaseException as fault:
                faults.append(fault)

    threads = [threading.Thread(target=reader) for _ in range(2)]
    for thread in threads:
        thread.start()
    texts = [str(k % 10) * (50 + k) for k in range(80)]
    for text in texts:
        files.replace_small(spark, path, text)
    stop.set()
    for thread in threads:
        thread.join()
    assert not faults and len(seen) > 1 and seen <= {*texts, "0" * 50}
    assert files.read_small(spark, path) == texts[-1] and files.names_in(spark, str(tmp_path)) == ["_pointer.json"]


def test_a_changed_byte_is_found(spark, tmp_path):
    folder = str(tmp_path / "v")
    versions.write(spark.range(1000).repartition(3), folder)
    path = tmp_path / "v" / versions.current(spark, folder)["version"]
    held = files.digests(spark, str(path)).collect()
    import hashlib

    parts = {p.name: p.read_bytes() for p in path.glob("part-*")}
    assert {r["name"]: (r["bytes"], r["sha256"]) for r in held} == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in parts.items()} and len(held) == 3
    name, data = next(iter(parts.items()))
    for crc in path.glob(".*.crc"):
        crc.unlink()
    (path / name).write_bytes(data[:50] + bytes([data[50] ^ 1]) + data[51:])
    with pytest.raises(ValueError, match="not those"):
        versions.read(spark, folder, verify=True)
    (path / name).unlink()
    with pytest.raises(ValueError, match="not those"):
        versions.read(spark, folder, verify=True)

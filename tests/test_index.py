import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomset import cli
from loomset.operators import index, retrieval, text


def test_index_and_search(spark):
    kinds = {"garden": "rose leaf moss soil seed root petal", "harbour": "boat sail rope tide anchor dock mast", "kitchen": "pan oven spoon flour knife bowl salt"}
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(kinds[k].split(), 40)), k) for i, k in enumerate(np.tile(list(kinds), 20).tolist())]
    rows += [(900, rows[0][1], "garden"), (901, None, "garden"), (902, "", None)]
    frame = spark.createDataFrame(rows, "id long, body string, product string")
    built = index.build(frame, "id", "body", "product", most=500, dimensions=6, rounds=4)
    assert built.chunks.count() == 60 and 0 < built.explained <= 1
    found = index.search(built, "a boat with a sail", 5).collect()
    assert [r["rank"] for r in found] == [1, 2, 3, 4, 5] and {r["product"] for r in found} == {"harbour"}
    assert index.search(built, "boat sail", 5, retrieval.Filters(equal=(("product", "KITCHEN"),)), min_score=0.0).count() == 5
    assert index.search(built, "boat", 5, retrieval.Filters(topic_id=1)).count() == 0 and index.search(built, "unseen", 3).count() == 0
    with pytest.raises(ValueError):
        index.search(built, "  ")


def test_directions_explain_what_the_best_ones_do(spark):
    rng = np.random.default_rng(1)
    x = rng.random((80, 3)) @ rng.random((3, 20)) + 0.01 * rng.random((80, 20))
    frame = spark.createDataFrame([(list(range(20)), row.tolist()) for row in x], "places array<int>, values array<double>").repartition(3)
    basis, explained = index.directions(frame, 20, 3)
    best = np.linalg.svd(x)[2][:3].T
    assert np.allclose(basis @ basis.T, best @ best.T, atol=1e-4) and explained > 0.95


def test_command_line(spark, data, capsys):
    cli.main([data, "sql", "SELECT count(*) AS n FROM region"])
    assert json.loads(capsys.readouterr().out)["rows"] == [[5]]
    cli.main([data, "overview", "1996-01", "1996-12"])
    assert json.loads(capsys.readouterr().out)["complaint_count"] > 0
    cli.main([data, "metrics"])
    assert len(json.loads(capsys.readouterr().out)) == 6


def test_command_line_search_filters(spark, tmp_path, capsys):
    rows = [(i, f"late fee account kind{i % 5} branch{i % 4} {'bank' if i % 2 else 'card'}", "fees" if i % 2 else "loans", f"2025-0{1 + i % 6}-10", i % 3) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, issue string, date string, topic_id int").withColumn("source", F.lit("s"))
    folder = str(tmp_path / "index")
    index.save(index.build(frame, "doc_id", "text", "source", dimensions=4), folder)
    ask = lambda *more: {r["doc_id"] for r in (cli.main([str(tmp_path), "search", folder, "bank card kind0 kind1 kind2 kind3 kind4", "--top-k", "50", *more]), json.loads(capsys.readouterr().out))[1]["results"]}
    wanted = lambda test: {r[0] for r in rows if test(r)}
    assert ask("--equal", "issue=FEES") == wanted(lambda r: r[2] == "fees")
    assert ask("--date-from", "2025-02-10", "--date-to", "2025-03-31") == wanted(lambda r: "2025-02-10" <= r[3] <= "2025-03-31")
    assert ask("--topic-id", "1", "--equal", "issue=loans", "--date-to", "2025-04-10") == wanted(lambda r: r[4] == 1 and r[2] == "loans" and r[3] <= "2025-04-10")
    with pytest.raises(SystemExit):
        ask("--equal", "nothing=1")


def test_search_finds_what_brute_force_over_all_rows_finds(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "source", "text")
    built = index.build(docs, "doc_id", "text", "source", most=40, dimensions=16, rounds=4)
    first = {}
    for r in docs.filter("text IS NOT NULL").orderBy("doc_id").collect():
        first.setdefault(r["text"], r["doc_id"])
    assert {r["doc_id"] for r in built.chunks.select("doc_id").distinct().collect()} == {i for t, i in first.items() if t.strip()}
    idf = {r["term"]: r["idf"] for r in built.vocabulary.collect()}
    place = {r["term"]: r["place"] for r in built.terms.collect()}

    def weigh(counts):
        rows = {}
        for r in counts:
            if r["term"] in idf:
                rows.setdefault(r[0], np.zeros(len(place)))[place[r["term"]]] = (1 + np.log(r["tf"])) * idf[r["term"]]
        return {k: x / np.linalg.norm(x) for k, x in rows.items()}

    unit = lambda y: y / max(np.linalg.norm(y), 1e-12)
    everything = text.chunks(spark.createDataFrame([(i, t) for t, i in first.items()], "doc_id long, text string"), "doc_id", "text")
    rows = weigh(index.counts_of(everything, "chunk_id", "chunk_text").collect())
    queries = docs.filter("doc_id % 100 = 0").collect()
    assert queries
    hits = wanted = 0
    for q in queries:
        x = next(iter(weigh(index.counts_of(spark.createDataFrame([(0, q["text"])], "_q int, query string"), "_q", "query").collect()).values()))
        score = {k: 0.65 * np.clip(unit(y @ built.directions) @ unit(x @ built.directions), 0, 1) + 0.35 * (y @ x) for k, y in rows.items()}
        best = sorted(score, key=lambda k: (-round(score[k], 6), k))[:8]
        found = {r["chunk_id"] for r in index.search(built, q["text"], 8, min_score=0.0).collect()}
        hits, wanted = hits + len(found & set(best)), wanted + len(best)
    assert hits >= 0.9 * wanted


def test_a_saved_index_answers_alike_and_must_reconcile(spark, tmp_path):
    rows = [(i, f"{'identity theft credit report' if i % 3 == 0 else 'overdraft fee bank account' if i % 3 == 1 else 'debt collector phone call'} number {i} with words shared by all of them", "abc"[i % 3]) for i in range(30)]
    built = index.build(spark.createDataFrame(rows, "id long, body string, product string"), "id", "body", "product", dimensions=4)
    folder = str(tmp_path / "index")
    manifest = index.save(built, folder)
    assert manifest["rows"]["chunks"] == 30 and manifest["rows"]["vectors"] == 30
    again = index.opened(spark, folder)
    assert again is index.opened(spark, folder)
    ask = lambda i: [tuple(r) for r in index.search(i, "credit identity", 5).select("rank", "chunk_id", "score").collect()]
    assert ask(again) == ask(built) and all(int(r[1].split("_")[0]) % 3 == 0 for r in ask(again))
    built.vectors.limit(7).write.mode("overwrite").parquet(f"{folder}/vectors")
    with pytest.raises(ValueError, match="reconcile"):
        index.load(spark, folder)
    with pytest.raises(FileNotFoundError):
        index.load(spark, str(tmp_path / "nowhere"))

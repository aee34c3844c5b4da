"""Topics from singular directions, saved and loaded, and given to new texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomset.operators import index, topic_model, topics

KINDS = {"garden": "rose leaf moss soil seed root petal", "harbour": "boat sail rope tide anchor dock mast", "kitchen": "pan oven spoon flour knife bowl salt"}


def some_texts(spark, n=90, seed=4):
    rng = np.random.default_rng(seed)
    rows = [(i, " ".join(rng.choice(KINDS[k].split(), 25)), k) for i, k in enumerate(np.tile(list(KINDS), n // 3).tolist())]
    return spark.createDataFrame(rows, "id long, body string, kind string"), rows


def test_a_model_separates_and_comes_back_from_disk(spark, tmp_path):
    frame, rows = some_texts(spark)
    model = topic_model.learn(frame, "id", "body", 3, bigrams=False)
    found = {r["id"]: (r["topic_id"], r["topic_label"]) for r in topic_model.score(model, frame, "id", "body").collect()}
    told = {k: {found[i] for i, _, kind in rows if kind == k} for k in KINDS}
    assert all(len(x) == 1 for x in told.values()) and len(set.union(*told.values())) == 3
    folder = str(tmp_path / "model")
    topic_model.save(model, folder)
    again = topic_model.load(spark, folder)
    later, more = some_texts(spark, 30, seed=9)
    later = later.unionByName(spark.createDataFrame([(900, "never seen", None), (901, None, None), (902, "", None)], later.schema))
    one, two = (sorted(map(tuple, topic_model.score(m, later, "id", "body").collect())) for m in (model, again))
    assert one == two and len(one) == 33
    assert all((r[1], r[2]) in told[next(k for i, _, k in more if i == r[0])] for r in one if r[0] < 900)
    assert [tuple(r[1:]) for r in one if r[0] >= 900] == [(-1, None, 0.0)] * 3
    path = next((tmp_path / "model" / "topics").glob("part-*"))
    for crc in path.parent.glob(".*.crc"):
        crc.unlink()
    path.write_bytes(path.read_bytes()[:-1] + b"x")
    with pytest.raises(ValueError, match="changed"):
        topic_model.load(spark, folder)
    with pytest.raises(ValueError, match="too few"):
        topic_model.learn(frame.limit(1), "id", "body", 3)


def test_the_start_is_no_worse_than_a_random_one(spark):
    rng = np.random.default_rng(5)
    x = rng.random((120, 4)) ** 3 @ rng.random((4, 30)) ** 3 + 0.02 * rng.random((120, 30))
    rows = spark.createDataFrame([(list(range(30)), r.tolist()) for r in x], "places array<int>, values array<double>").repartition(3).cache()

    def error(h):
        w = topics._solve(x @ h.T, h, 200)
        return float(((x - w @ h) ** 2).sum())

    first = topic_model.start(rows, 30, 4)
    assert first.shape == (4, 30) and (first > 0).all()
    best = np.linalg.svd(x)[2][:4]
    span = best.T @ best
    assert np.linalg.norm(span @ first[0] - first[0]) < 0.05 * np.linalg.norm(first[0])
    for rounds in (2, 30):
        mine, random = (error(topics.factorise(rows, 30, 4, rounds=rounds, first=f)) for f in (first, None))
        assert mine <= random * 1.02, (rounds, mine, random)
    rows.unpersist()


def test_directions_explain_what_a_full_decomposition_does(spark):
    rng = np.random.default_rng(1)
    x = rng.random((80, 3)) @ rng.random((3, 20)) + 0.01 * rng.random((80, 20))
    frame = spark.createDataFrame([(list(range(20)), row.tolist()) for row in x], "places array<int>, values array<double>").repartition(3)
    basis, explained = index.directions(frame, 20, 3)
    y = x @ np.linalg.svd(x)[2][:3].T
    assert abs(explained - y.var(0).sum() / x.var(0).sum()) < 1e-6
    assert frame.select(F.size("places")).first()[0] == len(basis)

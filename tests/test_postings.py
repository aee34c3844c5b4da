"""Blocks of postings against scoring everything, what is read, and many questions at once against one after another."""

import random

import pytest
from pyspark.sql import functions as F

from loomset.operators import index, postings, retrieval


@pytest.fixture(scope="module")
def weighted():
    """(key, term, weight) of 600 documents: common terms, rare ones, and copies, which tie."""
    rng = random.Random(2)
    rows = []
    for k in range(600):
        source = rng.choice(rows)[0] if k % 10 == 9 else None
        if source is not None:
            rows += [(k, t, w) for key, t, w in list(rows) if key == source]
            continue
        terms = {f"common{rng.randint(0, 9)}" for _ in range(4)} | {f"rare{rng.randint(0, 400)}" for _ in range(3)}
        rows += [(k, t, round(rng.uniform(0.1, 1) * (3 if t.startswith("rare") else 1), 3)) for t in sorted(terms)]
    return rows


def exhaustive(weighted, questions, top_k):
    out = {}
    for q, terms in questions.items():
        score = {}
        for key, term, weight in weighted:
            if term in terms:
                score[key] = score.get(key, 0.0) + weight * terms[term]
        out[q] = [(k, round(s, 6)) for k, s in sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:top_k]]
    return {q: found for q, found in out.items() if found}


def asked(spark, questions):
    return spark.createDataFrame([(q, t, w) for q, terms in questions.items() for t, w in terms.items()], "question string, term string, query_weight double")


def found(search):
    out = {}
    for r in search.best.orderBy("question", "rank").collect():
        out.setdefault(r["question"], []).append((r["key"], round(r["lexical"], 6)))
    return out


def test_pruned_search_gives_what_scoring_everything_gives(spark, weighted, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "PROBED", 4)
    frame = spark.createDataFrame(weighted, "key long, term string, weight double")
    postings.write(frame, "key", str(tmp_path / "p"), buckets=8, size=8)
    held = postings.read(spark, str(tmp_path / "p"))
    rng = random.Random(4)
    every = sorted({t for _, t, _ in weighted})
    questions = {f"q{k}": {t: round(rng.uniform(0.1, 1), 3) for t in rng.sample(every, rng.randint(1, 6))} for k in range(25)}
    questions |= {"rare": {"rare7": 1.0}, "common": {f"common{i}": 0.5 for i in range(10)}, "unknown": {"never": 1.0}, "mixed": {"never": 1.0, "rare3": 0.2, "common1": 0.01}}
    for top_k in (1, 7, 50):
        search = postings.search(held, asked(spark, questions), top_k)
        assert found(search) == exhaustive(weighted, questions, top_k)
    few = postings.search(held, asked(spark, {"mixed": questions["mixed"]}), 1)
    assert few.read.count() < few.ranges.count() / 2
    with pytest.raises(ValueError):
        postings.search(held, asked(spark, questions), 0)


def files_read(frame):
    """Files that the scans of a frame read."""
    spark = frame.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        frame = frame.select("*")
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan()
        plan.execute().count()
        leaves = plan.collectLeaves()
        return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_files_that_are_read_grow_with_the_terms(spark, weighted, tmp_path):
    postings.write(spark.createDataFrame(weighted, "key long, term string, weight double"), "key", str(tmp_path / "p"), buckets=16, size=64)
    held = postings.read(spark, str(tmp_path / "p"))
    one, three, all_ = (files_read(x) for x in (held.of_terms(held.blocks, ["rare3"]), held.of_terms(held.blocks, ["rare3", "rare4", "common1"]), held.blocks))
    assert 0 < one < three < all_
    assert {r["term"] for r in held.of_terms(held.blocks, ["rare3", "common1"]).collect()} == {"rare3", "common1"}


def test_postings_must_be_complete(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        postings.read(spark, str(tmp_path / "nowhere"))
    postings.write(spark.createDataFrame([], "key long, term string, weight double"), "key", str(tmp_path / "none"))
    assert postings.search(postings.read(spark, str(tmp_path / "none")), asked(spark, {"q": {"a": 1.0}}), 3).best.count() == 0


def test_many_questions_equal_single_ones(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "QUESTIONS", 5)
    kinds = {"Garden": "rose leaf moss soil seed root petal", "harbour": "boat sail rope tide anchor dock mast", "kitchen": "pan oven spoon flour knife bowl salt"}
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(kinds[k].split(), k=30)), k) for i, k in enumerate(list(kinds) * 20)] + [(99, "rose boat pan", None)]
    built = index.build(spark.createDataFrame(rows, "id long, body string, product string"), "id", "body", "product", dimensions=6, rounds=4)
    folder = str(tmp_path / "index")
    index.save(built, folder)
    for held in (built, index.load(spark, folder)):
        questions = [(i, " ".join(rng.choices(" ".join(kinds.values()).split(), k=4)), rng.choice([None, "", "garden", "HARBOUR", "kitchen"])) for i in range(17)] + [(50, "unseen words", None)]
        many = {}
        for r in index.search_many(held, spark.createDataFrame(questions, "question long, query string, product string"), 5, match=("product",)).orderBy("question", "rank").collect():
            many.setdefault(r["question"], []).append((r["rank"], r["chunk_id"], round(r["score"], 5)))
        single = {}
        for i, query, product in questions:
            found = index.search(held, query, 5, retrieval.Filters(equal=(("product", product or ""),))).collect()
            if found:
                single[i] = [(r["rank"], r["chunk_id"], round(r["score"], 5)) for r in found]
        assert many == single
    assert index.search_many(built, spark.createDataFrame([], "question long, query string"), 5).count() == 0


def test_a_saved_index_reads_the_folders_of_the_terms_asked_for(spark, tmp_path):
    rows = [(i, f"word{i} shared text of number{i % 7} and more{i % 3}", "abc"[i % 3]) for i in range(40)]
    frame = spark.createDataFrame(rows, "id long, body string, product string").unionByName(spark.createDataFrame(rows, "id long, body string, product string").withColumn("id", F.col("id") + 100).withColumn("body", F.concat("body", F.lit(" again"))))
    built = index.build(frame, "id", "body", "product", dimensions=4)
    folder = str(tmp_path / "index")
    index.save(built, folder)
    held = index.load(spark, folder)
    folders = index._buckets(spark, ["number3"])
    assert len(folders) == 1 and files_read(held.postings.filter(F.col("bucket").isin(folders))) < files_read(held.postings)
    assert [r["chunk_id"] for r in index.search(held, "word5 number5", 2).collect()] == [r["chunk_id"] for r in index.search(built, "word5 number5", 2).collect()] == ["5_0", "105_0"]

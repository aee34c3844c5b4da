"""Terms counted where the texts are against counts that are dealt out."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomset.operators import counting, index, postings, text, topic_model, topics


def some_texts(spark, n=120):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)] + ["été", "the", "naïve", "x_y"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 40))), "ab"[i % 2]) for i in range(n)] + [(900, None, "a"), (901, "", "b"), (902, "the of", None)]
    return spark.createDataFrame(rows, "id long, body string, kind string").repartition(3)


def told(frame):
    return {r["term"]: (r["df"], round(r["idf"], 12)) for r in frame.collect()}


@pytest.mark.parametrize(("bigrams", "features"), [(False, 20), (True, 10), (True, 45), (True, 150), (True, 30_000)])
def test_vocabulary_and_weights_are_those_of_dealt_out_counts(spark, monkeypatch, bigrams, features):
    monkeypatch.setattr(counting, "ROWS", 7)
    frame = some_texts(spark)
    held, n = counting.words(frame, "id", "body", "kind"), frame.count()
    counts = text.term_counts(frame, "id", "body", bigrams=bigrams)
    old, new = (f(x, n, min_df=2, max_df=0.6, max_features=features) for f, x in ((text.vocabulary, counts), (lambda h, n, **b: counting.vocabulary(h, n, bigrams, **b), held)))
    assert told(old) == told(new) and 0 < len(told(old)) <= features
    terms = topics.numbered(old.select("term"))
    wanted = {r["id"]: (list(r["places"]), list(r["values"])) for r in topics.rows_of(text.weights(counts, old, "id"), terms, "id").collect()}
    found = counting.rows(held, "id", old.join(terms, "term"), np.eye(terms.count())[:, :2], ("kind",))
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    rows = found.collect()
    assert {r["id"] for r in rows} == set(wanted) and len(rows) == len(wanted)
    for r in rows:
        assert list(r["places"]) == wanted[r["id"]][0] and np.allclose(r["values"], wanted[r["id"]][1]) and r["kind"] in "ab"
        own = dict(zip(*wanted[r["id"]], strict=True))
        y = np.array([own.get(0, 0.0), own.get(1, 0.0)])
        assert np.allclose(r["vector"], y / max(np.linalg.norm(y), 1e-12), atol=1e-6)


def test_words_that_are_too_many_to_be_known_everywhere_are_left_to_dealt_out_counts(spark, monkeypatch):
    monkeypatch.setattr(counting, "MOST_WORDS", 3)
    assert counting.vocabulary(counting.words(some_texts(spark), "id", "body"), 123, bigrams=True) is None


def test_chunks_that_share_an_id_are_counted_together(spark):
    frame = spark.createDataFrame([(1, "rose leaf moss rose leaf"), (1, "rose boat"), (2, "boat sail leaf moss"), (3, "rose leaf sail")], "id long, body string")
    chunks = text.chunks(frame, "id", "body")
    assert not counting.unique(chunks, "chunk_id") and counting.unique(chunks.filter("id > 1"), "chunk_id")
    vocabulary, held = index.taught(chunks)
    counts = index.counts_of(chunks, "chunk_id", "chunk_text")
    assert held is None and told(vocabulary) == told(text.vocabulary(counts, 4))
    terms = topics.numbered(vocabulary.select("term"))
    built = index.assemble(chunks, vocabulary, terms, np.eye(terms.count())[:, :2], held=held)
    assert built.rows is None and {r["chunk_id"] for r in built.vectors.collect()} == {"1_0", "2_0", "3_0"} and built.vectors.count() == 3
    weights = {(r["chunk_id"], r["term"]): r["weight"] for r in built.postings.collect()}
    assert weights == {(r["chunk_id"], r["term"]): r["weight"] for r in text.weights(counts, vocabulary, "chunk_id").collect()}


def test_an_index_holds_one_row_a_chunk_and_deals_out_no_weights(spark):
    chunks = text.chunks(some_texts(spark), "id", "body")
    vocabulary, held = index.taught(chunks)
    terms = topics.numbered(vocabulary.select("term"))
    built = index.assemble(chunks, vocabulary, terms, np.eye(terms.count())[:, :3], held=held)
    counts = index.counts_of(chunks, "chunk_id", "chunk_text")
    wanted = {(r["chunk_id"], r["term"]): round(r["weight"], 12) for r in text.weights(counts, vocabulary, "chunk_id").collect()}
    assert {(r["chunk_id"], r["term"]): round(r["weight"], 12) for r in built.postings.collect()} == wanted
    asked = built.chunks.select(F.col("chunk_id").alias("question"), F.col("chunk_text").alias("query"), "kind")
    best = {}
    for r in index.search_many(built, asked, 3, match=("kind",), min_score=0.0).orderBy("question", "rank").collect():
        best.setdefault(r["question"], []).append(r)
    kind = {r["chunk_id"]: r["kind"] for r in chunks.collect()}
    assert set(best) == {key for key, _ in wanted}
    for question, found in best.items():
        assert len(found) == 3 and {kind[r["chunk_id"]] for r in found} == {kind[question]} and found[0]["lexical"] > 1 - 1e-6


def test_many_long_questions_are_scored_where_the_documents_are(spark, tmp_path, monkeypatch):
    frame = some_texts(spark, 200)
    copies = frame.filter("id < 40").withColumn("id", F.col("id") + 1000)  # these tie
    held = counting.words(frame.union(copies), "id", "body")
    vocabulary = counting.vocabulary(held, 243)
    terms = topics.numbered(vocabulary.select("term"))
    rows = counting.rows(held, "id", vocabulary.join(terms, "term"))
    weights = text.weights(text.term_counts(frame.union(copies), "id", "body"), vocabulary, "id")
    postings.write(weights, "id", str(tmp_path / "p"), buckets=4)
    asked = weights.filter("id % 3 = 0").select(F.col("id").alias("question"), "term", F.col("weight").alias("query_weight"))
    wanted = postings.search(postings.read(spark, str(tmp_path / "p")), asked, 7).best
    monkeypatch.setattr(postings, "QUESTIONS", 20)
    monkeypatch.setattr(postings, "RANGE", 9)
    found = postings.search_rows(rows, "id", rows.filter("id % 3 = 0").withColumnRenamed("id", "question"), terms.count(), 7)
    told = lambda frame: sorted((r["question"], r["rank"], r["key"], round(r["lexical"], 9)) for r in frame.collect())
    assert told(found) == told(wanted) and len(told(found)) > 400
    none = postings.search_rows(rows, "id", rows.filter("id < 0").withColumnRenamed("id", "question"), terms.count(), 7)
    assert none.count() == 0 and none.columns == found.columns


def test_wide_products_are_plain_products():
    rng = np.random.default_rng(3)
    x = np.where(rng.random((50, 400)) < np.linspace(0, 0.4, 400), rng.random((50, 400)), 0)
    x[7] = 0
    row, place = np.nonzero(x)
    wide = rng.random((400, 30))
    assert np.allclose(topics.product(row, place, x[row, place], 50, wide), x @ wide)


def test_topics_are_learned_and_given_without_dealing_out_counts(spark, monkeypatch):
    frame = some_texts(spark).filter("id < 900")
    repeated = frame.union(frame.filter("id = 3"))
    before = topic_model.score(topic_model.learn(repeated, "id", "body", 3), repeated, "id", "body").count()
    assert before == 121  # ids that repeat are counted together, and each row gets the topic of its id

    def refused(*args, **more):
        raise AssertionError("counts are dealt out")

    monkeypatch.setattr(text, "term_counts", refused)
    model = topic_model.learn(frame, "id", "body", 3)
    found = {r["id"]: r["topic_id"] for r in topic_model.score(model, frame, "id", "body").collect()}
    assert len(found) == 120 and len(set(found.values())) > 1

"""Topics that are learned once, saved, and given to texts that come later.

Factors start from the leading singular directions of the rows, cut into non-negative parts: of the positive and the negative part of a pair of singular vectors
the heavier one is taken. Directions come from the distributed rows (index.directions), and one more pass gives each direction's singular value and the weight of both parts of the
document side; only these few numbers and the directions themselves visit the driver. Places that this leaves empty get the mean of all weights, so that rounds can fill them.

A saved model has its terms, factors and labels as Parquet and a manifest, which is written last. Scores of a text depend on the model and the text alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.operators import counting, index, text, topics
from loomset.session import kept
from loomset.sources import files


class TooFewTerms(ValueError):
    """The texts have fewer terms than topics can be made of."""


@dataclass
class TopicModel:
    """vocabulary: term, idf and place. factors: topics x terms. labels: of each topic."""

    vocabulary: DataFrame
    factors: np.ndarray
    labels: list[str]
    bigrams: bool = True


def start(rows: DataFrame, width: int, count: int, seed: int = 42) -> np.ndarray:
    """Non-negative topics x width from singular directions. rows: places and values, read once a round."""
    basis, _ = index.directions(rows, width, max(2, count), seed=seed)
    kept_ = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cross, total = np.zeros((kept_, kept_)), np.zeros(2)
        for batch in batches:
            for part in topics.sparse(batch):
                y = topics.times(*part, basis)
                cross += y.T @ y
                total += [part[2].sum(), part[3]]
        flat = np.concatenate([cross.ravel(), total])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["spot", "value"])

    def summed(function, size: int) -> np.ndarray:
        found = rows.select("places", "values").mapInArrow(function, "spot long, value double").groupBy("spot").agg(F.sum("value").alias("value")).toArrow()
        out = np.zeros(size)
        out[found.column("spot").to_numpy()] = found.column("value").to_numpy()
        return out

    flat = summed(run, kept_ * kept_ + 2)
    mean = flat[-2] / max(1.0, flat[-1] * width)
    # within the directions' space the singular ones are the eigenvectors of a small matrix
    values, turns = np.linalg.eigh(flat[:-2].reshape(kept_, kept_))
    order = np.argsort(-values)[:count]
    right = basis @ turns[:, order]
    sizes = np.sqrt(np.maximum(values[order], 0))

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares = np.zeros((2, len(order)))
        for batch in batches:
            for part in topics.sparse(batch):
                y = topics.times(*part, right)
                squares += [(np.maximum(y, 0) ** 2).sum(0), (np.minimum(y, 0) ** 2).sum(0)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(squares.size)), pa.array(squares.ravel())], ["spot", "value"])

    left = np.sqrt(summed(sides, 2 * len(order)).reshape(2, -1)) / np.maximum(sizes, 1e-12)
    out = np.zeros((count, width))
    for k in range(len(order)):
        halves = np.maximum(right[:, k], 0), np.maximum(-right[:, k], 0)
        weights = [float(np.linalg.norm(h)) for h in halves]
        best = int(left[1, k] * weights[1] > left[0, k] * weights[0])
        if k == 0:  # rows are non-negative, so the first direction has one sign
            out[k] = np.sqrt(sizes[0]) * np.abs(right[:, 0])
        elif weights[best] > 0:
            out[k] = np.sqrt(sizes[k] * left[best, k] * weights[best]) * halves[best] / weights[best]
    out[out <= 0] = mean
    return out


def learn(texts: DataFrame, key: str, body: str, count: int, min_df: int = 2, max_df: float = 0.95, max_features: int = topics.MAX_FEATURES, bigrams: bool = True, seed: int = 42) -> TopicModel:
    """Topics of texts. Fewer than `count` if there are too few texts or terms; texts without any term in the vocabulary teach nothing."""
    n, held, found = texts.count(), None, None
    if counting.unique(texts, key):
        held = kept(counting.words(texts, key, body), "words")
        found = counting.vocabulary(held, n, bigrams, min_df=min_df, max_df=max_df, max_features=max_features)
    counts = kept(text.term_counts(texts, key, body, bigrams=bigrams), "counts") if found is None else None
    vocabulary = kept(text.vocabulary(counts, n, min_df=min_df, max_df=max_df, max_features=max_features) if found is None else found, "vocabulary")
    placed = kept(vocabulary.select("term", "idf").join(topics.numbered(vocabulary.select("term")), "term"), "terms")
    names = [r["term"] for r in placed.select("term").orderBy("place").collect()]  # max_features at most
    if len(names) < 3:
        raise TooFewTerms("too few terms for topics")
    rows = counting.rows(held, key, placed) if counts is None else topics.rows_of(text.weights(counts, F.broadcast(vocabulary), key), placed.select("term", "place"), key)
    rows = kept(rows.select("places", "values"), "rows")
    count = max(1, min(count, n - 1, len(names) - 1))
    factors = topics.factorise(rows, len(names), count, seed, first=start(rows, len(names), count, seed))
    return TopicModel(placed, factors, topics.labels(factors, names), bigrams)


def score(model: TopicModel, texts: DataFrame, key: str, body: str) -> DataFrame:
    """key, topic_id, topic_label and topic_score of each text; a text without a known term has the topic -1, no label and the score 0. Ids are each there once."""
    vocabulary = model.vocabulary
    if counting.unique(texts, key):
        rows = counting.rows(counting.words(texts, key, body), key, vocabulary)
    else:
        counts = text.term_counts(texts, key, body, bigrams=model.bigrams, among=vocabulary)
        rows = topics.rows_of(text.weights(counts, F.broadcast(vocabulary.select("term", "idf")), key), vocabulary.select("term", "place"), key)
    found = topics.assign(rows, key, model.factors, model.labels).withColumnRenamed(key, "_key")
    joined = texts.select(key).join(found, F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.select(key, F.coalesce("topic_id", F.lit(-1).cast("long")).alias("topic_id"), "topic_label", F.coalesce("topic_score", F.lit(0.0)).alias("topic_score"))


def save(model: TopicModel, folder: str) -> dict:
    """Writes the model, and its manifest last; gives the manifest."""
    spark = model.vocabulary.sparkSession
    model.vocabulary.select("term", "idf", "place").write.mode("overwrite").parquet(f"{folder}/vocabulary")
    rows = [(k, label, row.tolist()) for k, (label, row) in enumerate(zip(model.labels, model.factors, strict=True))]  # a row a topic
    spark.createDataFrame(rows, "topic_id int, label string, weights array<double>").write.mode("overwrite").parquet(f"{folder}/topics")
    told = {"topics": len(rows), "terms": int(model.factors.shape[1]), "bigrams": model.bigrams, "digests": {x: files.digest(spark, f"{folder}/{x}") for x in ("vocabulary", "topics")}}
    files.replace_small(spark, f"{folder}/manifest.json", json.dumps(told, sort_keys=True))
    return told


def load(spark: SparkSession, folder: str) -> TopicModel:
    """A saved model; files that are not those that were saved are an error."""
    told = json.loads(files.read_small(spark, f"{folder}/manifest.json"))
    if changed := [name for name, held in told["digests"].items() if files.digest(spark, f"{folder}/{name}") != held]:
        raise ValueError(f"files of the model in {folder} have changed: {', '.join(changed)}")
    rows = spark.read.parquet(f"{folder}/topics").orderBy("topic_id").collect()
    return TopicModel(spark.read.parquet(f"{folder}/vocabulary"), np.array([r["weights"] for r in rows]), [r["label"] for r in rows], told["bigrams"])

"""Quality of texts by compression with two dictionaries.

1. From labelled training texts, SAMPLE_TEXTS of each label at most, pieces of PIECE characters are taken, PIECES_OF_TEXT of a
   text at most, wherever they stand, PIECES in all at most. One zstandard dictionary is trained from the good pieces and one from the bad.
   Which texts and pieces are taken follows from hashes, so the sample is the same each time. These bounds are the only
   ones there are; they bound what the driver sees.
2. Every whole text is compressed with either dictionary and with none. The difference of the two sizes, a byte of text, says which
   label's texts it is more like.
3. A logistic curve fitted on CALIBRATION_TEXTS other labelled texts at most turns it into a probability. Size without
   a dictionary and length are its other terms, as the same difference means less in a text that repeats itself or is short.

Null texts count as empty; they get the score that the curve has for length 0. Without labels of both kinds all scores
are the share of good labels, or one half if there are none. Rows are scored one by one: repeated ids need nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.llm.langid import held_out
from loomset.llm.textarray import slices

SAMPLE_TEXTS = 4_000
CALIBRATION_TEXTS = 8_000
PIECE, PIECES_OF_TEXT, PIECES = 400, 6, 4_000
DICTIONARY_BYTES = 112_640
LEVEL = 3
THRESHOLD = 0.7
RIDGE = 1e-2


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...] = ()
    centre: tuple[float, ...] = ()
    spread: tuple[float, ...] = ()
    prior: float = 0.5
    level: int = field(default=LEVEL)


@lru_cache(4)
def _compressors(good: bytes, bad: bytes, level: int):
    import zstandard

    out = []
    for data in (good, bad, b""):
        more = {}
        if data:
            more["dict_data"] = zstandard.ZstdCompressionDict(data)
            more["dict_data"].precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False, write_dict_id=False, **more))
    return out


def features(texts: list[str | None], good: bytes, bad: bytes, level: int = LEVEL) -> np.ndarray:
    """(difference a byte, plain size a byte, log of the length) of each text."""
    as_good, as_bad, plain = _compressors(good, bad, level)
    out = np.empty((len(texts), 3))
    for i, text in enumerate(texts):
        data = (text or "").encode()
        n = max(1, len(data))
        out[i] = (len(as_bad.compress(data)) - len(as_good.compress(data))) / n, len(plain.compress(data)) / n, math.log1p(len(data))
    return out


def _labelled(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts for the dictionaries, texts for calibration), both text and quality, both bounded."""
    order = F.xxhash64("doc_id", "quality")
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).distinct()
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    learn = usable.filter(fold != 3)
    learn = learn.filter("quality = 1").orderBy(order).limit(SAMPLE_TEXTS).union(learn.filter("quality = 0").orderBy(order).limit(SAMPLE_TEXTS))
    judge = usable.filter(fold == 3).orderBy(order).limit(CALIBRATION_TEXTS)
    # 2 * SAMPLE_TEXTS + CALIBRATION_TEXTS pairs of numbers at most
    both = F.broadcast(learn.withColumn("learn", F.lit(True)).union(judge.withColumn("learn", F.lit(False))))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(both, "doc_id")
    return texts.filter("learn"), texts.filter("NOT learn")


def _pieces(texts: DataFrame) -> DataFrame:
    """quality and piece, PIECES of each label at most."""
    starts = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(PIECE))
    cut = F.transform(starts, lambda a: F.struct(F.xxhash64(F.col("doc_id"), a).alias("spot"), F.substring(F.col("text"), a, F.lit(PIECE)).alias("piece")))
    rows = texts.select("quality", F.explode(F.slice(F.array_sort(cut), 1, PIECES_OF_TEXT)).alias("p")).select("quality", "p.spot", "p.piece").filter("piece <> ''")
    return rows.filter("quality = 1").orderBy("spot").limit(PIECES).union(rows.filter("quality = 0").orderBy("spot").limit(PIECES)).select("quality", "piece")


def dictionary(pieces: list[str]) -> bytes:
    """A dictionary trained from pieces; the pieces themselves if they are too few to train from."""
    import zstandard

    data = [p.encode() for p in sorted(pieces)]
    if not data:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, data, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(data)[-DICTIONARY_BYTES:]


def fit(values: np.ndarray, good: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights with the constant first, centre, spread) of a logistic curve, by Newton's method with a small ridge."""
    centre, spread = values.mean(0), values.std(0) + 1e-9
    rows = np.c_[np.ones(len(values)), (values - centre) / spread]
    weights = np.zeros(rows.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        hessian = rows.T @ (rows * (p * (1 - p))[:, None]) + RIDGE * np.eye(len(weights))
        step = np.linalg.solve(hessian, rows.T @ (good - p) - RIDGE * weights)
        weights += step
        if np.abs(step).max() < 1e-9:
            break
    return weights, centre, spread


def learn(documents: DataFrame, labels: DataFrame) -> Model:
    learning, judging = _labelled(documents, labels)
    found = _pieces(learning).toArrow().to_pylist()
    good, bad = (dictionary([r["piece"] for r in found if r["quality"] == q]) for q in (1, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                values = features(rows.column("text").to_pylist(), good, bad)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("quality"), *(pa.array(values[:, k]) for k in range(3))], ["doc_id", "quality", "a", "b", "c"])

    seen = judging.select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, a double, b double, c double").toArrow().sort_by([(c, "ascending") for c in ("doc_id", "quality", "a", "b", "c")])
    quality = seen.column("quality").to_numpy()
    prior = float(quality.mean()) if len(quality) else 0.5
    if not len(quality) or quality.min() == quality.max():
        return Model(good, bad, prior=prior)
    weights, centre, spread = fit(np.stack([seen.column(c).to_numpy() for c in "abc"], 1), quality)
    return Model(good, bad, tuple(weights), tuple(centre), tuple(spread), prior)


def score(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                sure = np.full(rows.num_rows, model.prior)
                if model.weights:
                    values = (features(rows.column("text").to_pylist(), model.good, model.bad, model.level) - model.centre) / model.spread
                    sure = 1 / (1 + np.exp(-np.clip(model.weights[0] + values @ np.array(model.weights[1:]), -30, 30)))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(sure), pa.array((sure >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def qualities(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents, learned from the labels (doc_id, quality) of those that are not held out."""
    return score(documents, learn(documents, labels))

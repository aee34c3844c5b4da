"""Topics of texts by non-negative factors, and how they are distributed over months and groups.

Documents stay distributed as rows of term weights. The topic-term matrix H (topics x at most MAX_FEATURES terms) is small whatever
the number of documents; each round, every task computes the weights W of its documents for H and returns WᵀX and WᵀW, which are
as small as H. So a round is one pass over the rows and one sum.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_FEATURES = 20_000
ROUNDS, INNER = 30, 8
TOLERANCE = 1e-4
_TINY = 1e-9


def rows_of(weights: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """key, places and values: each document's weights as one sparse row. terms: term and place."""
    placed = weights.join(F.broadcast(terms), "term")  # MAX_FEATURES rows at most
    pairs = placed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "weight"))).alias("p"))
    return pairs.select(key, F.col("p.place").alias("places"), F.col("p.weight").alias("values"))


def numbered(terms: DataFrame) -> DataFrame:
    """term and its place in the order of terms. terms: MAX_FEATURES rows at most."""
    return terms.agg(F.array_sort(F.collect_list("term")).alias("t")).select(F.posexplode("t").alias("place", "term"))


def sparse(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(row, place, value, how many rows) of a few hundred rows at once; rows ascend."""
    places, values = batch.column("places"), batch.column("values")
    for at in range(0, batch.num_rows, 256):
        p, v = places.slice(at, 256), values.slice(at, 256)
        n = np.diff(p.offsets.to_numpy())
        yield np.repeat(np.arange(len(n)), n), p.flatten().to_numpy(), v.flatten().to_numpy(), len(n)


def times(row: np.ndarray, place: np.ndarray, value: np.ndarray, n: int, basis: np.ndarray) -> np.ndarray:
    """Sparse rows times basis."""
    out = np.zeros((n, basis.shape[1]))
    if len(row):
        start = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        out[row[start]] = np.add.reduceat(basis[place] * value[:, None], start)
    return out


def product(row: np.ndarray, place: np.ndarray, value: np.ndarray, n: int, wide: np.ndarray) -> np.ndarray:
    """times() for a wide matrix: places that a sixteenth of the rows have are one dense product, the others are added a few thousand values at once."""
    common = np.flatnonzero(np.bincount(place, minlength=len(wide)) * 16 >= max(n, 1))
    out = np.zeros((n, wide.shape[1]))
    if len(common):
        spot = np.full(len(wide), -1)
        spot[common] = np.arange(len(common))
        use = spot[place] >= 0
        dense = np.zeros((n, len(common)))
        dense[row[use], spot[place[use]]] = value[use]
        out = dense @ wide[common]
        row, place, value = row[~use], place[~use], value[~use]
    for low in range(0, len(row), 4_096):
        some = row[low : low + 4_096]
        start = np.flatnonzero(np.append(True, some[1:] != some[:-1]))
        scaled = wide[place[low : low + 4_096]]
        scaled *= value[low : low + 4_096, None]
        out[some[start]] += np.add.reduceat(scaled, start)
    return out


def _solve(cross: np.ndarray, h: np.ndarray, rounds: int = INNER) -> np.ndarray:
    """Non-negative weights of rows for fixed topics, by coordinate descent. cross: the rows times the topics."""
    gram = h @ h.T
    w = np.maximum(cross / np.maximum(np.diag(gram), _TINY), 0) / len(h)
    for _ in range(rounds):
        for k in range(len(h)):
            w[:, k] = np.maximum(w[:, k] + (cross[:, k] - w @ gram[:, k]) / max(gram[k, k], _TINY), 0)
    return w


def factorise(rows: DataFrame, width: int, topics: int, seed: int = 42, rounds: int = ROUNDS, first: np.ndarray | None = None) -> np.ndarray:
    """H: topics x width. rows: places and values; they are read once a round, so a kept table is best. first: where to begin (else a seeded random H)."""
    rng = np.random.default_rng(seed)
    h = rng.random((topics, width)) / width + _TINY if first is None else first / np.maximum(np.sqrt((first**2).sum(1, keepdims=True)), _TINY)
    last = None
    for turn in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], h: np.ndarray = h) -> Iterator[pa.RecordBatch]:
            across = np.ascontiguousarray(h.T)
            wx, ww, xx = np.zeros(h.shape), np.zeros((len(h), len(h))), 0.0
            for batch in batches:
                for part in sparse(batch):
                    row, place, value, _ = part
                    w = _solve(times(*part, across), h)
                    for k in range(len(h)):
                        wx[k] += np.bincount(place, w[row, k] * value, h.shape[1])
                    ww += w.T @ w
                    xx += float((value**2).sum())
            flat = np.concatenate([wx.ravel(), ww.ravel(), [xx]])
            full = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(flat[full])], ["spot", "value"])

        sums = rows.select("places", "values").mapInArrow(run, "spot long, value double").groupBy("spot").agg(F.sum("value").alias("value")).toArrow()
        if turn % 5 == 4:  # else the sums of all rounds stay on disk until the driver happens to collect its garbage
            gc.collect()
            rows.sparkSession.sparkContext._jvm.System.gc()
        flat = np.zeros(topics * width + topics * topics + 1)
        flat[sums.column("spot").to_numpy()] = sums.column("value").to_numpy()
        wx, ww, xx = flat[: topics * width].reshape(topics, width), flat[topics * width : -1].reshape(topics, topics), flat[-1]
        error = xx - 2 * float((wx * h).sum()) + float((ww * (h @ h.T)).sum())
        for _ in range(INNER):
            for k in range(topics):
                if ww[k, k] > _TINY:
                    h[k] = np.maximum(h[k] + (wx[k] - ww[k] @ h) / ww[k, k], 0)
        empty = h.sum(1) <= _TINY
        h[empty] = rng.random((int(empty.sum()), width)) / width
        h /= np.maximum(np.sqrt((h**2).sum(1, keepdims=True)), _TINY)
        if last is not None and abs(last - error) <= TOLERANCE * max(xx, _TINY):
            break
        last = error
    return h


def labels(h: np.ndarray, terms: list[str], top: int = 6) -> list[str]:
    """The heaviest terms of each topic (ties by term), joined by ' / '."""
    return [" / ".join(terms[i] for i in sorted(range(len(terms)), key=lambda i: (-row[i], terms[i]))[:top]) for row in h]


def assign(rows: DataFrame, key: str, h: np.ndarray, names: list[str]) -> DataFrame:
    """key, topic_id (of the greatest weight, the first of equal ones), topic_label and topic_score."""
    across = np.ascontiguousarray(h.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = np.concatenate([_solve(times(*part, across), h) for part in sparse(batch)])
                best = w.argmax(1)
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(best, pa.int64()), pa.array([names[i] for i in best.tolist()]), pa.array(w.max(1))], [key, "topic_id", "topic_label", "topic_score"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "places", "values").mapInArrow(run, f"`{key}` {kind}, topic_id long, topic_label string, topic_score double")


def cube(assigned: DataFrame, month: str, group: str) -> DataFrame:
    """month, group, topic_id, topic_label, narrative_count, group_month_total and share; null is a group like others."""
    cells = assigned.groupBy(month, group, "topic_id", "topic_label").agg(F.count(F.lit(1)).alias("narrative_count"))
    total = F.sum("narrative_count").over(Window.partitionBy(month, group))
    return cells.withColumn("group_month_total", total).withColumn("share", F.col("narrative_count") / F.col("group_month_total"))


def totals(cells: DataFrame) -> DataFrame:
    """Topics by how many texts they have over all months: counts are summed again, shares never averaged."""
    return cells.groupBy("topic_id", "topic_label").agg(F.sum("narrative_count").alias("narrative_count")).orderBy(F.desc("narrative_count"), "topic_id")

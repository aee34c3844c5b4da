"""Vocabularies and term weights of texts, counted where the texts are.

A text's terms are counted in the task that has it, so its counts and weights need no shuffle. What is dealt out are sums for each word, and for pairs of
neighbouring words sums for each pair that can matter: a pair is no more frequent than either of its words, nor than all pairs of its slot of a table of SLOTS
sums, so what is below the last place that words alone would fill is never counted by itself. The vocabulary is that of text.vocabulary(), weights are those of text.weights().

All this needs keys that are each there once; unique() tells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.operators import text
from loomset.session import kept

#: Sums of pairs of words, by a hash, and how many of them are one row.
SLOTS, BLOCK = 1 << 20, 1 << 15
#: Rows and words of a batch that are counted at once (a longer text alone), and bytes of a batch.
ROWS, WORDS, BYTES = 2_048, 1 << 20, 16 << 20
#: Words that are given numbers at most, as every task gets them all; with more, pairs are counted as strings.
MOST_WORDS = 500_000


def unique(rows: DataFrame, key: str) -> bool:
    """Whether every key is there once."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def words(texts: DataFrame, key: str, body: str, *others: str) -> DataFrame:
    """key, the other columns and words (without stop words, in order)."""
    texts.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)  # texts can be long
    return texts.select(key, *others, text.tokens(F.col(body)).alias("words"))


def _cut(lists: pa.ListArray) -> Iterator[tuple[int, pa.ListArray, np.ndarray]]:
    """(first row, lists, row of each value) of some rows at once."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(lengths), 0
    while at < len(lists):
        most = (ends[at - 1] if at else 0) + WORDS
        end = max(at + 1, min(at + ROWS, int(np.searchsorted(ends, most, "right"))))
        yield at, lists.slice(at, end - at), np.repeat(np.arange(end - at), lengths[at:end])
        at = end


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, pa.Array, np.ndarray]]:
    """(first row, how many rows, row of each word, distinct words, number of each word among them) of some rows at once."""
    for at, some, row in _cut(batch.column("words")):
        coded = some.flatten().dictionary_encode()
        yield at, len(some), row, coded.dictionary, coded.indices.to_numpy().astype(np.int64)


def _sums(row: np.ndarray, code: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, how often), sorted, of codes below width."""
    both, many = np.unique(row * width + code, return_counts=True)
    return both // width, both % width, many


def word_sums(held: DataFrame) -> DataFrame:
    """term, df and corpus_tf of single words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, row, names, code in _parts(batch):
                _, once, _ = _sums(row, code, max(1, len(names)))
                columns = [names, pa.array(np.bincount(once, minlength=len(names))), pa.array(np.bincount(code, minlength=len(names)))]
                yield pa.RecordBatch.from_arrays(columns, ["term", "df", "corpus_tf"])

    found = held.select("words").mapInArrow(run, "term string, df long, corpus_tf long")
    return found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("corpus_tf").alias("corpus_tf"))


def _pairs(row: np.ndarray, code: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, first * width + second) of neighbours that both have a number."""
    both = (row[1:] == row[:-1]) & (code[1:] >= 0) & (code[:-1] >= 0)
    return row[:-1][both], code[:-1][both] * width + code[1:][both]


def _slot(pair: np.ndarray) -> np.ndarray:
    return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


def _numbered(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, number of the word or -1) of some rows at once."""
    for _, some, row in _cut(batch.column("codes")):
        yield row, some.flatten().to_numpy().astype(np.int64)


def pair_sums(held: DataFrame, names: list[str], least: int) -> DataFrame:
    """term, df and corpus_tf of neighbours among the named words, of all that are there `least` times or more (and of some others)."""
    spark, width = held.sparkSession, len(names)
    shared = spark.sparkContext.broadcast(pa.array(names, pa.string()))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, n, row, found, code in _parts(batch):
                numbers = pc.index_in(found, value_set=shared.value).fill_null(-1).to_numpy().astype(np.int32)
                offsets = pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(numbers[code] if len(code) else code.astype(np.int32)))], ["codes"])

    coded = kept(held.select("words").mapInArrow(number, "codes array<int>"), "codes")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for row, code in _numbered(batch):
                total += np.bincount(_slot(_pairs(row, code, width)[1]), minlength=SLOTS)
        blocks = total.reshape(-1, BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks)), pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(len(blocks) + 1) * BLOCK, pa.int32()), pa.array(total))], ["block", "sums"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = table.column("sums").combine_chunks().flatten().to_numpy().reshape(-1, BLOCK).sum(0)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "wanted": pa.array([np.packbits(total >= least).tobytes()], pa.binary())})

    # a bit a slot comes to the driver
    bits = coded.mapInArrow(slots, "block int, sums array<long>").groupBy("block").applyInArrow(add, "block int, wanted binary").toArrow().sort_by("block")
    wanted = spark.sparkContext.broadcast(np.unpackbits(np.frombuffer(b"".join(bits.column("wanted").to_pylist()), np.uint8)).astype(bool) if bits.num_rows else np.zeros(SLOTS, bool))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, code in _numbered(batch):
                row, pair = _pairs(row, code, width)
                use = wanted.value[_slot(pair)]
                found, place = np.unique(pair[use], return_inverse=True)
                _, once, _ = _sums(row[use], place, max(1, len(found)))
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.bincount(once, minlength=len(found))), pa.array(np.bincount(place, minlength=len(found)))], ["pair", "df", "corpus_tf"])

    sums = coded.mapInArrow(count, "pair long, df long, corpus_tf long").groupBy("pair").agg(F.sum("df").alias("df"), F.sum("corpus_tf").alias("corpus_tf")).filter(F.col("corpus_tf") >= least)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = batch.column("pair").to_numpy()
            first, second = (shared.value.take(pa.array(x)) for x in (pair // width, pair % width))
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(first, second, " "), batch.column("df"), batch.column("corpus_tf")], ["term", "df", "corpus_tf"])

    return sums.mapInArrow(spell, "term string, df long, corpus_tf long")


def vocabulary(held: DataFrame, documents: int, bigrams: bool = False, min_df: int = 2, max_df: float = 0.98, max_features: int = 30_000) -> DataFrame | None:
    """What text.vocabulary() gives; held: words of each text. None if too many words would have to be known everywhere."""
    sums = kept(word_sums(held).filter(F.col("df") >= min_df), "word-sums")
    if bigrams:
        best = sums.filter(F.col("df") <= max_df * documents).orderBy(F.desc("corpus_tf"), "term").limit(max_features)
        full = best.agg(F.count(F.lit(1)).alias("n"), F.min("corpus_tf").alias("least")).first()
        # what is rarer than the last word of a full vocabulary of words has no place in one of words and pairs
        least = max(min_df, full["least"]) if full["n"] == max_features else min_df
        frequent = sums.filter(F.col("corpus_tf") >= least)
        if frequent.count() > MOST_WORDS:
            return None
        names = [r["term"] for r in frequent.select("term").orderBy("term").collect()]
        sums = kept(sums.unionByName(pair_sums(held, names, least)), "sums")
    return text.chosen(sums, documents, min_df, max_df, max_features)


def rows(held: DataFrame, key: str, terms: DataFrame, basis: np.ndarray | None = None, others: tuple[str, ...] = ()) -> DataFrame:
    """key, the other columns, places and values: each text's weights as one sparse row, none for a text without terms. terms: term, idf and place, so few that every task has them.

    basis: terms x dimensions; then there is also vector, of length one (all zeros if nothing of the row is in it).
    """
    spark = held.sparkSession
    table = terms.select("place", "term", "idf").orderBy("place").toArrow()
    idf, width = table.column("idf").to_numpy(), table.num_rows
    spelled = [t.split(" ") for t in table.column("term").to_pylist()]
    known = sorted({w for t in spelled for w in t})
    number = {w: i for i, w in enumerate(known)}
    single, pairs = np.full(len(known) + 1, -1, np.int64), []
    for place, t in enumerate(spelled):
        if len(t) == 1:
            single[number[t[0]]] = place
        else:
            pairs.append((number[t[0]] * len(known) + number[t[1]], place))
    pairs.sort()
    shared = spark.sparkContext.broadcast((pa.array(known, pa.string()), single, np.array(pairs, np.int64).reshape(-1, 2), idf, basis))
    columns = [key, *others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, single, pairs, idf, basis = shared.value
        for batch in batches:
            for at, n, row, found, code in _parts(batch):
                code = pc.index_in(found, value_set=known).fill_null(-1).to_numpy().astype(np.int64)[code] if len(found) else code
                place = single[code]
                use = place >= 0
                r, p = row[use], place[use]
                if len(pairs):
                    pair_row, pair = _pairs(row, code, len(known))
                    spot = np.minimum(np.searchsorted(pairs[:, 0], pair), len(pairs) - 1)
                    hit = pairs[spot, 0] == pair
                    r, p = np.concatenate([r, pair_row[hit]]), np.concatenate([p, pairs[spot[hit], 1]])
                r, p, tf = _sums(r, p, max(1, width))
                weight = (1 + np.log(tf)) * idf[p]
                weight /= np.sqrt(np.bincount(r, weight**2, n))[r]
                ends = np.searchsorted(r, np.arange(n + 1))
                full = np.flatnonzero(np.diff(ends))
                offsets = pa.array(np.append(0, ends[1:][full]), pa.int32())
                rest = [batch.column(c).slice(at, n).take(pa.array(full)) for c in columns]
                out = [*rest, pa.ListArray.from_arrays(offsets, pa.array(p, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(weight))]
                if basis is not None:
                    out.append(_vectors(np.searchsorted(full, r), p, weight, len(full), basis))
                yield pa.RecordBatch.from_arrays(out, [*columns, "places", "values", *(["vector"] if basis is not None else [])])

    kinds = [f"`{c}` {held.schema[c].dataType.simpleString()}" for c in columns]
    more = ", vector array<float>" if basis is not None else ""
    return held.select(*(F.col(f"`{c}`") for c in columns), "words").mapInArrow(run, f"{', '.join(kinds)}, places array<int>, values array<double>{more}")


def _vectors(row: np.ndarray, place: np.ndarray, value: np.ndarray, n: int, basis: np.ndarray) -> pa.Array:
    """Sparse rows times basis, at length one."""
    y = np.zeros((n, basis.shape[1]))
    for at in range(0, n, 256):
        low, high = np.searchsorted(row, (at, at + 256))
        start = np.flatnonzero(np.append(True, row[low + 1 : high] != row[low : high - 1])) if high > low else np.zeros(0, np.int64)
        if len(start):
            y[row[low:high][start]] = np.add.reduceat(basis[place[low:high]] * value[low:high, None], start)
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * y.shape[1], pa.int32()), pa.array(y.astype(np.float32).ravel()))

"""Near-duplicate documents: MinHash with banding, confirmed on full shingle sets, joined into components.

1. Each document's set of distinct five-word shingles (a shorter text is one shingle) gives HASHES
   minima of universal hashes, cut into bands of ROWS, and a name of the whole set.
2. Rows with one and the same set are one class from here on; the text of its least row stands for it.
3. Classes that share a band meet in a bucket. Each class is compared, on full sets, with the least one that it meets in any
   bucket: one pair for each class, and enough to join most of a group of copies. The links give components.
4. Buckets that still hold several components are gone through once more, in blocks. Signatures are compared inside the
   task; rows with a partner of another component whose signature agrees in at least AGREE places (which a pair at the
   threshold misses once in some 10**8 times) and that they meet in no earlier band get their texts, and are compared on full sets inside
   their block. Rows are dealt out, never pairs, and a block reports fewer links than it has components.

A pair at the threshold shares no band once in 10**5 times (0.684 ** 32); closer pairs far less often. No bucket is
capped and no pair is linked without its full sets.

Null or wordless texts have an empty set and are linked with nothing. Rows without a doc_id are not compared: their component is
null and they are kept. What is linked are texts: rows that repeat a doc_id with different texts are nodes of their own, each with the
component of its own text, so a text that has no copy stays whatever else stands under its id. Of the rows of a component the first one, by
doc_id and then by a hash of the text, is marked; rows that repeat id and text are marked alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.llm.common import by_key, discard, keep
from loomset.llm.components import components
from loomset.llm.textarray import BYTE_BASE, WORD_BASE, lower_ascii, mix, per_row, range_hash, slices, utf8, word_hashes, words

SHINGLE = 5
#: Links hold if 100 * intersection >= PERCENT * union.
PERCENT = 75
HASHES, ROWS = 128, 4
AGREE = 68
#: Rows of a bucket that are compared in one task.
BLOCK = 1024

_random = np.random.default_rng(20_240_601)
_FACTORS = (_random.integers(0, 1 << 32, HASHES, np.uint64) | np.uint64(1)).astype(np.uint32)
_TERMS = _random.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32)


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased."""
    data, offsets = utf8(column)
    data = lower_ascii(data)
    start, end, row = words(data, offsets)
    first = per_row(row, len(offsets) - 1)
    word = word_hashes(data, start, end)
    count = np.diff(first)
    begins = np.minimum(np.arange(len(word)) + size, first[1:][row]) if len(word) else np.zeros(0, np.int64)
    hashes = range_hash(word, np.arange(len(word)), begins, WORD_BASE)
    out = []
    for a, n in zip(first[:-1].tolist(), count.tolist(), strict=True):
        out.append(np.unique(hashes[a : a + max(n - size + 1, 1)]) if n else np.zeros(0, np.uint64))
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES minima for each non-empty set."""
    begin = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), HASHES), np.uint32)
    for i in range(HASHES):
        out[:, i] = np.minimum.reduceat(x * _FACTORS[i] + _TERMS[i], begin)
    return out


def text_hash() -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(F.col("text").cast("string"))


def _identified(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"))


def signatures(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, both hashes of the whole set, band keys and one byte of each minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                sets = shingle_sets(rows.column("text"))
                full = [i for i, s in enumerate(sets) if len(s)]
                bands: list[list[int] | None] = [None] * len(sets)
                sig: list[bytes | None] = [None] * len(sets)
                if full:
                    least = minima([sets[i] for i in full])
                    cells = least.reshape(len(full), HASHES // ROWS, ROWS).astype(np.uint64)
                    keys = np.broadcast_to(np.arange(HASHES // ROWS, dtype=np.uint64), cells.shape[:2]).copy()
                    for i in range(ROWS):
                        keys = mix(keys * np.uint64(WORD_BASE) + cells[:, :, i])
                    for i, k, s in zip(full, keys.view(np.int64).tolist(), least.astype(np.uint8), strict=True):
                        bands[i], sig[i] = k, s.tobytes()
                one = [int(mix(s).sum(dtype=np.uint64)) if len(s) else None for s in sets]
                two = [int(mix(s * np.uint64(BYTE_BASE)).sum(dtype=np.uint64)) if len(s) else None for s in sets]
                signed = [pa.array([None if v is None else v - (1 << 64) if v >> 63 else v for v in x], pa.int64()) for x in (one, two)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), *signed, pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())], ["doc_id", "text_hash", "n_shingles", "one", "two", "bands", "sig"])

    return _identified(documents).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, one long, two long, bands array<long>, sig binary")


def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose full sets agree. texts: rep, text."""
    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # many pairs share their first text: its set is made once
            first = batch.column("text_a").dictionary_encode()
            firsts = shingle_sets(first.dictionary)
            take = np.zeros(batch.num_rows, bool)
            for i, (k, s) in enumerate(zip(first.indices.to_pylist(), shingle_sets(batch.column("text_b")), strict=True)):
                both = len(np.intersect1d(firsts[k], s, assume_unique=True))
                take[i] = both > 0 and 100 * both >= PERCENT * (len(firsts[k]) + len(s) - both)
            yield batch.select(["a", "b"]).filter(pa.array(take))

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_b"):
                yield from run(iter([part]))

    return pairs.join(left, "a").join(right, "b").mapInArrow(small, "a long, b long")


#: Words of 64 bits of the table that rules out most documents before texts are dealt out: rows that are broadcast at most.
BIT_WORDS = 1 << 20


def _texts_of(documents: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """rep and text of the classes in pairs.

    A table of hashed bits, broadcast in BIT_WORDS rows at most, leaves few documents beside those wanted, so that
    texts of others need not move; the join that follows is exact.
    """
    reps = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    wanted = keep(reps.join(classes.select("rep", "doc_id", "text_hash"), "rep"), "wanted")
    word = F.pmod(F.shiftrightunsigned(F.xxhash64("doc_id"), 6), F.lit(BIT_WORDS)).cast("int").alias("_word")
    bit = F.expr("shiftleft(1L, cast(xxhash64(doc_id) & 63 as int))")
    bits = wanted.groupBy(word).agg(F.bit_or(bit).alias("_bits"))
    likely = _identified(documents).withColumn("_word", word).join(F.broadcast(bits), "_word").filter(F.col("_bits").bitwiseAND(bit) != 0).select("doc_id", "text_hash", "text")
    return keep(likely.join(wanted, ["doc_id", "text_hash"]).select("rep", "text").dropDuplicates(["rep"]), "texts")


def _blocks(buckets: DataFrame, classes: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of buckets that hold several components, dealt into cells of two blocks so that any two rows of a bucket meet in one cell."""
    rows = buckets.join(parts.withColumnsRenamed({"node": "rep", "component": "part"}), "rep", "left").select("key", "band", "rep", F.coalesce("part", "rep").alias("part"))
    mixed = rows.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo <> hi").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("cell"), (F.col("block") == F.col("other")).alias("same"), "block", "band", "rep", "part")


def _apart(i: int, block: np.ndarray, same: np.ndarray, part: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Later rows of a cell that row i is to be compared with."""
    later = slice(i + 1, None)
    fits = 100 * np.minimum(n[later], n[i]) >= PERCENT * np.maximum(n[later], n[i])
    return i + 1 + np.flatnonzero((part[later] != part[i]) & (same[i] | (block[later] != block[i])) & fits)


def _candidates(cells: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of cells that have a possible partner of another component which they meet in no earlier band."""

    def run(cell: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        part, block, n = (table.column(c).to_numpy() for c in ("part", "block", "n_shingles"))
        same = table.column("same").to_numpy(zero_copy_only=False)
        band = table.column("band")[0].as_py()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(n), HASHES)
        keys = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(n), HASHES // ROWS)
        take = np.zeros(len(n), bool)
        for i in range(len(n) - 1):
            j = _apart(i, block, same, part, n)
            j = j[(sig[j] == sig[i]).sum(1) >= AGREE]
            j = j[(keys[j] == keys[i]).argmax(1) == band]
            if len(j):
                take[i] = True
                take[j] = True
        yield from table.filter(pa.array(take)).select(["cell", "same", "block", "rep", "part", "n_shingles"]).combine_chunks().to_batches()

    rows = cells.join(classes.select("rep", "sig", "bands", "n_shingles"), "rep")
    return by_key(rows, "cell", [], run, "cell long, same boolean, block int, rep long, part long, n_shingles long")


def _cell_links(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links between components, compared on full sets inside each cell. Components that a cell has linked are one from there on, so a cell gives fewer links than it has components."""

    def run(cell: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        rep, part, block = (table.column(c).to_numpy() for c in ("rep", "part", "block"))
        part = part.copy()
        same = table.column("same").to_numpy(zero_copy_only=False)
        sets: list[np.ndarray] = []
        for batch in table.select(["text"]).to_batches():
            for rows in slices(batch):
                sets += shingle_sets(rows.column("text"))
        n = np.array([len(s) for s in sets])
        begin = np.cumsum(n) - n
        values, number = np.unique(np.concatenate(sets), return_inverse=True)
        mark = np.zeros(len(values), bool)
        left, right = [], []
        for i in range(len(rep) - 1):
            j = _apart(i, block, same, part, n)
            if not len(j):
                continue
            own = number[begin[i] : begin[i] + n[i]]
            mark[own] = True
            both = np.add.reduceat(mark[number[begin[i] :]], begin[i:] - begin[i], dtype=np.int64)[j - i]
            mark[own] = False
            j = j[100 * both >= PERCENT * (n[i] + n[j] - both)]
            if len(j):
                met, one = np.unique(part[j], return_index=True)
                left += [int(rep[i])] * len(one)
                right += rep[j[one]].tolist()
                part[np.isin(part, met)] = part[i]
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    rows = candidates.drop("n_shingles").join(texts, "rep").select("cell", "same", "block", "rep", "part", "text")
    pairs = by_key(rows, "cell", [], run, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable) and kept, for each row of documents.

    Also text_hash (of the row's text) and first: whether the row is the first one of its component, by doc_id and text_hash.
    """
    facts = keep(signatures(documents), "signatures")
    least, which = F.struct("doc_id", "text_hash"), F.struct("n_shingles", "bands", "sig")
    classes = facts.filter("one IS NOT NULL AND doc_id IS NOT NULL").groupBy("one", "two").agg(F.min(least).alias("least"), F.min_by(which, least).alias("f"))
    # numbers of rows of a table that is written once
    classes = keep(classes.select(F.monotonically_increasing_id().alias("rep"), "one", "two", "least.*", "f.*"), "classes")
    keys = classes.select("rep", "doc_id", F.posexplode("bands").alias("band", "key"))
    heads = keys.groupBy("key").agg(F.min(F.struct("doc_id", "rep")).alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "head")
    shared = keep(keys.drop("doc_id").join(heads, "key"), "buckets")
    stars = keep(shared.groupBy("rep").agg(F.min("head")["rep"].alias("head")).filter("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")), "pairs")
    texts = _texts_of(documents, classes, stars)
    links = keep(linked(stars, texts), "links")
    discard(texts)
    parts = keep(components(links), "parts")
    candidates = keep(_candidates(_blocks(shared.select("key", "band", "rep"), classes, parts), classes), "candidates")
    if not candidates.isEmpty():
        texts = _texts_of(documents, classes, candidates.select(F.col("rep").alias("a"), F.col("rep").alias("b")))
        links = links.union(keep(_cell_links(candidates, texts), "links"))
        discard(texts)
        parts = keep(components(links), "parts")
    members = parts.withColumnRenamed("node", "rep").join(classes.select("rep", "doc_id", "text_hash"), "rep")
    firsts = members.groupBy("component").agg(F.min(least).alias("first"))
    named = classes.join(parts.withColumnRenamed("node", "rep").join(firsts, "component"), "rep", "left")
    named = named.select("one", "two", F.coalesce("first", least).alias("first"))
    found = facts.join(named, ["one", "two"], "left")
    component = F.coalesce(F.col("first.doc_id"), F.col("doc_id"))
    alone = F.col("doc_id").isNull() | F.col("first").isNull()
    return found.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"),
        "text_hash", (alone | (least == F.col("first"))).alias("first"),
    )

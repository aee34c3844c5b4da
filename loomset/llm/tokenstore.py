"""Content-addressed store of token ids.

Layout of a store folder (Parquet throughout, so that any store Spark writes to will do):

* `parts/kind=chunk`: `hash` (SHA-256 of the payload), `payload` (ids, little-endian, two bytes each if
  the vocabulary allows, else four). Each distinct chunk is stored once.
* `parts/kind=ref`: which chunks a document has, as the writers saw them.
* `recipes`: per document, in ascending doc_id order: bucket, page, place in the bucket, chunk hashes, n_tokens and the Merkle
  root over its chunk hashes. A bucket is a range of doc_ids, a page PAGE documents of it.
* `pages`: per page: number of documents and ids, and the Merkle root over its documents' roots.
* `manifests`: per bucket: number of documents and ids, ids before the bucket, and the Merkle root over its pages' roots. store_root() is that over
  the buckets'. So no step gathers more than PAGE roots, or one root for each page or bucket.

Cuts depend on content only: an id ends a chunk when a rolling hash of the last ids has a given
remainder, so equal passages give equal chunks wherever they stand. Reading checks every level: payload
against hash, chunk list against the document's root, documents against their page, pages against the manifest.

Null texts are empty (their end id alone). Rows with the same or a null doc_id are documents of
their own; among equal ids the order is that of their roots. An empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomset.llm.common import shared_folder, shuffle_partitions, task_partition
from loomset.llm.textarray import slices
from loomset.llm.tokens import TEXT_BYTES, default_path, encoder, with_end

END_ID = 2
#: Ids that the rolling hash covers and mean distance of cuts (powers of two), least and greatest chunk.
ROLL, MEAN, LEAST, MOST = 16, 256, 64, 1024
#: Documents whose roots are gathered at once.
PAGE = 4_096
#: Hashes whose payload a task remembers having sent.
SENT = 200_000

NAMES = ["kind", "route", "doc_id", "task", "row", "nth", "hash", "n", "payload"]
_PART = "kind string, route long, doc_id long, task int, row long, nth int, hash binary, n long, payload binary"


def cuts(ids: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each row, counted from the row's first id."""
    marks = np.zeros(0, np.int64)
    if len(ids) >= ROLL:
        rolled = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        span, base = 1, 0xD1342543DE82EF95
        while span < ROLL:  # the hash of twice as many ids from two neighbouring ones
            rolled = rolled[:-span] * np.uint64(base) + rolled[span:]
            span, base = 2 * span, base * base % 2**64
        marks = np.flatnonzero((rolled >> np.uint64(64 - MEAN.bit_length() + 1)) == 0) + ROLL
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        ends, last, n = [], 0, b - a
        lo, hi = np.searchsorted(marks, (a + ROLL, b))
        for end in [*(marks[lo:hi] - a).tolist(), n]:
            while end - last > MOST:
                last += MOST
                ends.append(last)
            if end - last >= LEAST and end < n:
                ends.append(last := end)
        if n > last:
            ends.append(n)
        out.append(ends)
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """SHA-256 Merkle root; leaves and inner nodes are hashed apart, a single last node goes up as it is."""
    level = [hashlib.sha256(b"\x00" + x).digest() for x in leaves]
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else hashlib.sha256(b"").digest()


def _apply(matrix: tuple[int, ...], vector: int) -> int:
    out = 0
    while vector:
        low = vector & -vector
        out ^= matrix[low.bit_length() - 1]
        vector ^= low
    return out


@lru_cache(4096)
def _zeros(n: int) -> tuple[int, ...]:
    """What n zero bytes do to a CRC-32 register, as the images of its 32 bits."""
    if n == 1:
        out = []
        for bit in range(32):
            x = 1 << bit
            for _ in range(8):
                x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
            out.append(x)
        return tuple(out)
    half = _zeros(n // 2)
    double = tuple(_apply(half, x) for x in half)
    return tuple(_apply(_zeros(1), x) for x in double) if n & 1 else double


@lru_cache(64)
def _zero_table(k: int) -> np.ndarray:
    """What 4 * 2**k zero bytes do to a CRC-32 register: the images of each value of each of its four bytes, others 0."""
    images, out = _zeros(4 << k), np.zeros((4, 256), np.int64)
    for bit, image in enumerate(images):
        out[bit // 8, (np.arange(256) >> bit % 8 & 1) == 1] ^= image
    return out


def crc_of_lists(bounds: np.ndarray, n: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    """CRC-32 of each list of chunks, from where the lists begin and end, and from how many 32-bit ids each chunk has and their CRC-32. No list is empty."""
    total = np.cumsum(n)
    after, out = np.repeat(total[bounds[1:] - 1], np.diff(bounds)) - total, crcs.astype(np.int64)
    for k in range(int(after.max(initial=0)).bit_length()):
        at = np.flatnonzero(after >> k & 1)
        table, x = _zero_table(k), out[at]
        out[at] = table[0, x & 255] ^ table[1, x >> 8 & 255] ^ table[2, x >> 16 & 255] ^ table[3, x >> 24]
    return np.bitwise_xor.reduceat(out, bounds[:-1]) if len(bounds) > 1 else out


def write(documents: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encodes every whole text, appends end_id, and writes the store to the folder."""
    spark = documents.sparkSession
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        task, row = task_partition(), 0
        for batch in batches:
            for rows in slices(batch, limit=TEXT_BYTES):
                ids, offsets = with_end(*encoder(path).encode(rows.column("text")), end_id)
                wide = int(ids.max(initial=0)) > 0xFFFF
                size = 4 if wide else 2
                data = memoryview(np.ascontiguousarray(ids, "<u4" if wide else "<u2")).cast("B")
                ends = cuts(ids, offsets)
                many = np.array([len(x) for x in ends], np.int64)
                each = np.repeat(np.arange(len(many)), many)
                last = np.repeat(offsets[:-1], many) + np.fromiter((e for x in ends for e in x), np.int64, int(many.sum()))
                nth = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
                begin = np.where(nth == 0, offsets[:-1][each], np.concatenate([[0], last[:-1]])) if len(each) else last
                mark, keys, fresh = b"4" if wide else b"2", [], []
                for k, (x, y) in enumerate(zip((begin * size).tolist(), (last * size).tolist(), strict=True)):
                    digest = hashlib.sha256(mark)
                    digest.update(data[x:y])
                    keys.append(digest.digest())
                    if keys[-1] not in sent:
                        if len(sent) >= SENT:
                            sent.clear()
                        sent.add(keys[-1])
                        fresh.append(k)
                ids_of = rows.column("doc_id").take(pa.array(each))
                numbers = pa.array(row + each)
                refs = [pa.repeat("ref", len(each)), pc.coalesce(ids_of, numbers), ids_of, pa.repeat(pa.scalar(task, pa.int32()), len(each)), numbers, pa.array(nth, pa.int32()), pa.array(keys, pa.binary()), pa.array(last - begin), pa.nulls(len(each), pa.binary())]
                yield pa.RecordBatch.from_arrays(refs, NAMES)
                none = lambda kind, n=len(fresh): pa.nulls(n, kind)
                routes = np.frombuffer(b"".join(keys[k][:8] for k in fresh), "<i8")
                chunks = [pa.repeat("chunk", len(fresh)), pa.array(routes), none(pa.int64()), none(pa.int32()), none(pa.int64()), none(pa.int32()), pa.array([keys[k] for k in fresh], pa.binary()), pa.array(np.full(len(fresh), size)), pa.array([bytes(data[begin[k] * size : last[k] * size]) for k in fresh], pa.binary())]
                yield pa.RecordBatch.from_arrays(chunks, NAMES)
                row += rows.num_rows

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal chunks stand one after another."""
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("hash")
            again = pc.equal(keys, pa.concat_arrays([pa.array([last], pa.binary()), keys.slice(0, len(keys) - 1)]))
            is_chunk = pc.equal(batch.column("kind"), "chunk")
            yield batch.filter(pc.invert(pc.and_(is_chunk, pc.fill_null(again, False))))
            last = keys[-1].as_py() if is_chunk[-1].as_py() else None

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = texts.mapInArrow(run, _PART).repartition(shuffle_partitions(spark), "route").sortWithinPartitions("kind", "hash")
    dealt.mapInArrow(once, _PART).drop("route").write.option("compression", "zstd").partitionBy("kind").parquet(f"{folder}/parts")
    _write_recipes(spark, folder)


def _parts(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    schema = "doc_id long, task int, row long, nth int, hash binary, n long, payload binary, kind string"
    return spark.read.schema(schema).parquet(f"{folder}/parts").filter(F.col("kind") == kind)


def _lists(column: pa.ListArray) -> tuple[np.ndarray, pa.StructArray]:
    """(bounds, structs) of a column of lists without nulls."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([[0], np.cumsum(sizes)]), column.flatten()


def _write_recipes(spark: SparkSession, folder: str) -> None:
    refs = _parts(spark, folder, "ref").select("doc_id", "task", "row", F.struct("nth", "hash", "n").alias("ref"))
    lists = refs.groupBy("doc_id", "task", "row").agg(F.array_sort(F.collect_list("ref")).alias("refs"))

    def root(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            bounds, refs = _lists(batch.column("refs"))
            hashes, total = refs.field("hash"), np.concatenate([[0], np.cumsum(refs.field("n").to_numpy(zero_copy_only=False))]).astype(np.int64)
            held = hashes.to_pylist()
            roots = [merkle(held[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), hashes), pa.array(np.diff(total[bounds])), pa.array(roots, pa.binary())], ["doc_id", "chunks", "n_tokens", "root"])

    rooted = lists.mapInArrow(root, "doc_id long, chunks array<binary>, n_tokens long, root binary")
    ordered = rooted.repartitionByRange(shuffle_partitions(spark), "doc_id", "root").sortWithinPartitions("doc_id", "root")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, at, ids = task_partition(), 0, 0
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            begin = ids + np.cumsum(n) - n
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), bucket), pa.int32()), pa.array((at + np.arange(len(n))) // PAGE), pa.array(at + np.arange(len(n))), *batch.columns, pa.array(begin)], ["bucket", "page", "place", *batch.schema.names, "start_in_bucket"])
            at, ids = at + len(n), ids + int(n.sum())

    ordered.mapInArrow(number, "bucket int, page long, place long, doc_id long, chunks array<binary>, n_tokens long, root binary, start_in_bucket long").write.option("compression", "zstd").parquet(f"{folder}/recipes")
    _page_roots(_recipes(spark, folder)).write.option("compression", "zstd").parquet(f"{folder}/pages")
    _bucket_roots(_pages(spark, folder)).write.option("compression", "zstd").parquet(f"{folder}/manifests")


def _recipes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("bucket int, page long, place long, doc_id long, chunks array<binary>, n_tokens long, root binary, start_in_bucket long").parquet(f"{folder}/recipes")


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("bucket int, page long, n_documents long, n_tokens long, root binary").parquet(f"{folder}/pages")


def _rooted(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, n_documents, n_tokens and the Merkle root of the roots of each group, in order."""

    def root(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        whole = [pa.array([k.as_py()], rows_schema.field(c).type) for k, c in zip(key, keys, strict=True)]
        totals = [pa.array([sum(table[c].to_pylist())], pa.int64()) for c in ("n_documents", "n_tokens")]
        return pa.table([*whole, *totals, pa.array([merkle(table["root"].to_pylist())], pa.binary())], names=[*keys, "n_documents", "n_tokens", "root"])

    rows_schema = pa.schema([("bucket", pa.int32()), ("page", pa.int64())])
    kinds = {"bucket": "int", "page": "long"}
    return rows.groupBy(*keys).applyInArrow(root, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", n_documents long, n_tokens long, root binary")


def _page_roots(recipes: DataFrame) -> DataFrame:
    """One row for each PAGE documents of a bucket: only their 32-byte roots are gathered."""
    return _rooted(recipes.select("bucket", "page", "place", F.lit(1).cast("long").alias("n_documents"), "n_tokens", "root"), ["bucket", "page"], "place")


def _bucket_roots(pages: DataFrame) -> DataFrame:
    """bucket, n_documents, n_tokens, root and start (ids of earlier buckets).

    A bucket is one sorted file's worth of documents; the roots of its pages are gathered. The running sum is over one row for each bucket.
    """
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return _rooted(pages, ["bucket"], "page").withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def store_root(spark: SparkSession, folder: str) -> bytes:
    """The root of the whole store, over one root for each bucket."""
    return merkle([r["root"] for r in spark.read.parquet(f"{folder}/manifests").select("bucket", "root").orderBy("bucket").collect()])


def chunk_facts(spark: SparkSession, folder: str) -> DataFrame:
    """hash, n ids and CRC-32 (of 32-bit ids) of every stored chunk; fails if a payload is not what its hash says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, crcs = [], []
            for key, size, payload in zip(batch.column("hash").to_pylist(), batch.column("n").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if hashlib.sha256((b"4" if size == 4 else b"2") + payload).digest() != key:
                    raise ValueError(f"stored chunk {key.hex()} is damaged")
                ids = np.frombuffer(payload, "<u4" if size == 4 else "<u2")
                counts.append(len(ids))
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("hash"), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], ["hash", "n", "crc"])

    return _parts(spark, folder, "chunk").select("hash", "n", "payload").mapInArrow(run, "hash binary, n long, crc long")


def read_facts(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files and checked against recipes and manifests."""
    recipes = _recipes(spark, folder)
    buckets = spark.read.schema("bucket int, n_documents long, n_tokens long, root binary, start long").parquet(f"{folder}/manifests")
    stored, where = _pages(spark, folder), ["bucket", "page"]
    wrong = F.raise_error(F.lit("a manifest does not match its recipes"))
    same = lambda old, new: old.join(new.withColumnsRenamed({"root": "root_again", "n_documents": "n_again"}).drop("n_tokens"), [c for c in where if c in new.columns], "left").filter(F.when((F.col("root") == F.col("root_again")) & (F.col("n_documents") == F.col("n_again")), F.lit(True)).otherwise(wrong))
    sound_pages = same(stored, _page_roots(recipes)).select("bucket", "page")
    sound_buckets = same(buckets, _bucket_roots(stored).drop("start")).select("bucket", "start")
    checked = sound_pages.join(sound_buckets, "bucket").select("bucket", "page", "start", F.lit(True).alias("sound"))
    refs = recipes.select("bucket", "place", F.posexplode("chunks").alias("nth", "hash"))
    facts = refs.join(chunk_facts(spark, folder), "hash", "left").groupBy("bucket", "place").agg(F.array_sort(F.collect_list(F.struct("nth", "hash", "n", "crc"))).alias("chunks"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, chunks = _lists(batch.column("chunks"))
            hashes, sizes = chunks.field("hash").to_pylist(), chunks.field("n")
            if sizes.null_count:
                raise ValueError(f"chunk {hashes[sizes.to_pylist().index(None)].hex()} is not in the store")
            sizes = sizes.to_numpy()
            crcs = crc_of_lists(bounds, sizes, chunks.field("crc").to_numpy())
            totals = np.diff(np.concatenate([[0], np.cumsum(sizes)])[bounds])
            roots = [merkle(hashes[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("place"), pa.array(totals, pa.int64()), pa.array(crcs, pa.int64()), pa.array(roots, pa.binary())], ["bucket", "place", "total", "ids_crc32", "built_root"])

    built = facts.mapInArrow(build, "bucket int, place long, total long, ids_crc32 long, built_root binary")
    sound = F.coalesce("sound", F.lit(False)) & (F.col("total") == F.col("n_tokens")) & (F.col("root") == F.col("built_root"))
    return (
        recipes.drop("chunks")
        .join(built, ["bucket", "place"], "left")
        .join(checked, where, "left")
        .select("doc_id", (F.col("start") + F.col("start_in_bucket")).alias("start"), "n_tokens", F.when(sound, F.col("ids_crc32")).otherwise(F.raise_error(F.lit("a document does not match its recipe")).cast("long")).alias("ids_crc32"))
    )


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start and ids of each document, rebuilt from the stored chunks."""
    recipes = _recipes(spark, folder)
    buckets = spark.read.schema("bucket int, start long").parquet(f"{folder}/manifests").withColumnRenamed("start", "before")
    refs = recipes.select("bucket", "place", F.posexplode("chunks").alias("nth", "hash"))
    chunks = _parts(spark, folder, "chunk").select("hash", F.col("n").alias("size"), "payload")
    lists = refs.join(chunks, "hash", "left").groupBy("bucket", "place").agg(F.array_sort(F.collect_list(F.struct("nth", "size", "payload"))).alias("chunks"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.concatenate([np.frombuffer(c["payload"], "<u4" if c["size"] == 4 else "<u2").astype(np.int32) for c in x]) for x in batch.column("chunks").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("place"), pa.array(ids, pa.list_(pa.int32()))], ["bucket", "place", "ids"])

    built = lists.mapInArrow(build, "bucket int, place long, ids array<int>")
    return recipes.join(built, ["bucket", "place"]).join(buckets, "bucket").select("doc_id", (F.col("before") + F.col("start_in_bucket")).alias("start"), "ids")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"

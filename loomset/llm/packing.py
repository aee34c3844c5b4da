"""Best-fit packing of token sequences by large-item matching.

1. Each text becomes ids plus an end id. A document longer than the capacity is cut into pieces of
   full capacity, the first of which may be shorter. One pass over the texts; only the lengths, places
   and checksums of pieces go on.
2. A piece's length says all that packing needs, so the packer works on the counts of the 1 to
   `capacity` lengths, which is a table of at most `capacity` rows however large the corpus is.
   Lengths above a third of the capacity are matched greedily: the longest one with the longest other
   one that fits beside it, so at most two of them share a bin. Shorter ones, longest first, go to
   the smallest gap that takes them; a new bin is opened if there is none.
3. The n-th piece of a length takes the n-th place that the plan has for that length. Ranks are a
   piece's place among those of its partition plus what earlier partitions hold, so that neither a
   common length nor any other key meets in one task.

Null texts are empty: one piece, the end id alone. Null, repeated or clashing ids need nothing: rows
are packed as they are. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomset.llm.common import keep, task_partition
from loomset.llm.textarray import slices
from loomset.llm.tokens import TEXT_BYTES, default_path, encoder, with_end

CAPACITY = 1024
END_ID = 2

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def cut(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, piece, start, length) of the pieces of rows with these lengths, all of them at least 1."""
    first = (lengths - 1) % capacity + 1
    count = (lengths - first) // capacity + 1
    row = np.repeat(np.arange(len(lengths)), count)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
    return row, piece, start, np.where(piece == 0, first[row], capacity)


def pieces(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32, and part and nth, which number those of a length in a partition."""
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, np.int64)
        part = task_partition()
        for batch in batches:
            for rows in slices(batch, limit=TEXT_BYTES):
                ids, offsets = with_end(*encoder(path).encode(rows.column("text")), end_id)
                row, piece, start, length = cut(np.diff(offsets), capacity)
                at = offsets[row] + start
                data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crc = [zlib.crc32(data[a:b]) for a, b in zip((at * 4).tolist(), ((at + length) * 4).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                _, begin, count = np.unique(length[order], return_index=True, return_counts=True)
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(length)) - np.repeat(begin, count)
                nth += seen[length]
                np.add.at(seen, length, 1)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part), pa.int32()), pa.array(nth)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
                )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _PIECES)


class _Bins:
    """Bins as (contents, how many): contents are (length, how many of it in a bin)."""

    def __init__(self) -> None:
        self.by_gap: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = defaultdict(list)
        self.gaps: list[int] = []

    def put(self, gap: int, contents: tuple[tuple[int, int], ...], many: int) -> None:
        if many:
            if not self.by_gap[gap]:
                insort(self.gaps, gap)
            self.by_gap[gap].append((contents, many))

    def take(self, least: int) -> tuple[int, tuple[tuple[int, int], ...], int] | None:
        """Bins with the smallest gap of at least `least`."""
        i = bisect_left(self.gaps, least)
        if i == len(self.gaps):
            return None
        gap = self.gaps[i]
        contents, many = self.by_gap[gap].pop()
        if not self.by_gap[gap]:
            self.gaps.pop(i)
        return gap, contents, many


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Bins for counts[length] pieces of each length: [(contents of a bin, how many such bins)]."""
    left = {k: v for k, v in counts.items() if v}
    bins = _Bins()
    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        longest = large[-1]
        room = bisect_left(large, capacity - longest + 1) - 1
        mate = large[room] if room >= 0 else None
        if mate == longest:
            pairs = left[longest] // 2
            bins.put(capacity - 2 * longest, ((longest, 2),), pairs)
            left[longest] -= 2 * pairs
            if left[longest]:
                mate = large[room - 1] if room > 0 else None
        if left[longest]:
            if mate is None:
                bins.put(capacity - longest, ((longest, 1),), left.pop(longest))
            else:
                pairs = min(left[longest], left[mate])
                bins.put(capacity - longest - mate, ((longest, 1), (mate, 1)), pairs)
                left[longest] -= pairs
                left[mate] -= pairs
                if not left[mate]:
                    large.remove(mate)
        if not left.get(longest):
            left.pop(longest, None)
            large.remove(longest)
    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        many = left[length]
        while many:
            found = bins.take(length)
            if found is None:
                each = capacity // length
                bins.put(capacity - each * length, ((length, each),), many // each)
                rest = many % each
                if rest:
                    bins.put(capacity - rest * length, ((length, rest),), 1)
                break
            gap, contents, there = found
            each = min(gap // length, many)
            used = min(there, many // each)
            bins.put(gap, contents, there - used)
            bins.put(gap - each * length, (*contents, (length, each)), used)
            many -= used * each
    return [x for gap in bins.gaps for x in bins.by_gap[gap]]


def places(bins: Iterable[tuple[tuple[tuple[int, int], ...], int]]) -> np.ndarray:
    """Rows (length, first rank, how many in a bin, first sequence, offset), by length and rank."""
    rank: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for contents, many in bins:
        offset = 0
        for length, each in contents:
            out.append((length, rank[length], each, sequence, offset))
            rank[length] += each * many
            offset += each * length
        sequence += many
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pack(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Every piece of every document with its sequence: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cuts = keep(pieces(documents, capacity, tokenizer, end_id), "pieces")
    by_part = keep(cuts.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = places(plan(counts, capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = cuts.join(before, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    key = (table[:, 0] << 48) + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(key, (length << 48) + rank, "right") - 1
            nth, each = rank - table[at, 1], table[at, 2]
            sequence, offset = table[at, 3] + nth // each, table[at, 4] + nth % each * length
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

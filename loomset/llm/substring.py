"""Removal of passages that recur: windows of `window` words that also start anywhere else.

1. Anchors. Of the phrases of PHRASE words inside a window, the one with the least hash is the
   window's anchor, so equal windows have equal anchors wherever they stand. Neighbouring windows share
   anchors: a segment is the run of windows with one anchor. Only (anchor, segment) hashes are dealt out and counted.
2. Owners. Documents are dealt out into shards of about SHARD_BYTES, and of the shards that hold a segment the first one owns it.
   Of a segment that recurs, or whose anchor recurs in another segment (the end of a copy, an edit), the owner tells
   the words; of the latter ones it also tells two hashes of each window.
3. Confirmation. The words of a segment that recurs are a passage: all its windows recur. Of the other segments with recurring
   anchors, each run of windows whose two hashes were told more than once is a passage. Everything else has no partner.
   A passage is confirmed once, in the words of one owner, and goes to each shard that needs it.
4. Automata. Each shard compiles the passages it got, word for word, into an Aho-Corasick automaton (into several, one after another,
   if they are more than AUTOMATON_WORDS words) and streams all its documents through it. The hits, and nothing else, say which words
   go. Automata are as many as the corpus needs, and no document meets another shard's.

Counts come from partial aggregates and joins that split hot keys, so that a passage found in a third of all documents is
no task of its own. Words are runs of bytes other than space and 0x09 to 0x0D. Null text has no words. Rows with
equal or null ids are documents of their own, and passages within one document count.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomset.llm.common import by_key, discard, keep
from loomset.llm.textarray import WORD_BASE, per_row, range_hash, rolling_min_place, slices, utf8, window_starts, word_hashes, words

WINDOW = 35
PHRASE = 8
SHARD_BYTES = 4 << 20
#: Words of the passages that one automaton holds; a shard that needs more has several, one after another.
AUTOMATON_WORDS = 200_000
#: A second multiplier: windows are told apart by two independent hashes.
OTHER_BASE = 0xC2B2AE3D27D4EB4F

_SEGMENT, _TELL, _EXPAND, _PASSAGE, _DOCUMENT = 0, 1, 2, 3, 9


class _Text:
    """Windows and segments of some whole texts."""

    def __init__(self, column: pa.Array, window: int, phrase: int):
        self.data, offsets = utf8(column)
        self.start, self.end, row = words(self.data, offsets)
        self.first = per_row(row, len(offsets) - 1)
        self.word = word_hashes(self.data, self.start, self.end)
        self.at = window_starts(self.first, window)
        self.window = window
        if not len(self.at):
            self.anchor = self.segment = np.zeros(0, np.uint64)
            self.begin = self.size = np.zeros(0, np.int64)
            return
        from_ = np.arange(len(self.word) - phrase + 1)
        phrases = range_hash(self.word, from_, from_ + phrase, WORD_BASE)
        place = rolling_min_place(phrases, self.at, window - phrase + 1)
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (self.at[1:] != self.at[:-1] + 1)
        self.begin = np.flatnonzero(new)  # of segments, in windows
        self.size = np.diff(np.append(self.begin, len(place)))
        self.anchor = phrases[place[self.begin]]
        self.segment = range_hash(self.word, self.at[self.begin], self.at[self.begin + self.size - 1] + window, WORD_BASE)

    def windows(self, which: np.ndarray, base: int) -> np.ndarray:
        return range_hash(self.word, self.at[which], self.at[which] + self.window, base)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _shards(documents: DataFrame) -> DataFrame:
    """doc_id, text and the shard, which holds about SHARD_BYTES of text."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    return texts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int"))


def _segments(texts: DataFrame, window: int, phrase: int) -> DataFrame:
    """anchor, segment, shard and how often, one row for each slice of text that has the segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                text = _Text(rows.column("text"), window, phrase)
                if not len(text.begin):
                    continue
                row = np.searchsorted(text.first, text.at[text.begin], "right") - 1
                shard = rows.column("shard").to_numpy()[row].astype(np.int64)
                order = np.lexsort((text.segment, shard))
                anchor, segment, shard = text.anchor[order], text.segment[order], shard[order]
                new = np.ones(len(order), bool)
                new[1:] = (segment[1:] != segment[:-1]) | (shard[1:] != shard[:-1])
                at = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays([_signed(anchor[at]), _signed(segment[at]), pa.array(shard[at], pa.int32()), pa.array(np.diff(np.append(at, len(order))))], ["anchor", "segment", "shard", "n"])

    return texts.select("shard", "text").mapInArrow(run, "anchor long, segment long, shard int, n long")


def _marks(segments: DataFrame) -> DataFrame:
    """(shard, kind, key): which segments that recur a shard holds, which it tells the words of, and which also the windows of."""
    distinct = segments.groupBy("anchor", "segment").agg(F.sum("n").alias("n"), F.min("shard").alias("owner"))
    anchors = distinct.groupBy("anchor").agg(F.sum("n").alias("all"), F.min("n").alias("least")).filter("all >= 2")
    told = distinct.join(anchors, "anchor").select("anchor", "segment", (F.col("n") >= 2).alias("recurs"), (F.col("least") == 1).alias("ragged"), "owner").filter("recurs OR ragged")
    found = segments.join(told, ["anchor", "segment"])
    owned = F.col("shard") == F.col("owner")
    tells = F.when(owned, F.when(F.col("ragged"), F.lit(_EXPAND)).otherwise(F.lit(_TELL)))
    kinds = F.array_compact(F.array(F.when(F.col("recurs"), F.lit(_SEGMENT)), tells))
    # many slices of text may have told the same of one shard
    return found.select("shard", F.explode(kinds).alias("kind"), F.col("segment").alias("key")).distinct()


def _with_documents(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """rows: shard, kind, key and text."""
    none = F.lit(None)
    return rows.select("shard", "kind", "key", none.cast("long").alias("doc_id"), "text").unionByName(texts.select("shard", F.lit(_DOCUMENT).alias("kind"), none.cast("long").alias("key"), "doc_id", "text"))


def _of_kind(table: pa.Table, kind: int) -> pa.Table:
    return table.filter(pa.array(table.column("kind").to_numpy() == kind))


def _keys(table: pa.Table, kind: int) -> np.ndarray:
    """Sorted keys of one kind."""
    return np.unique(_of_kind(table, kind).column("key").to_numpy().astype(np.int64).view(np.uint64))


def _texts(table: pa.Table) -> Iterator[pa.RecordBatch]:
    for batch in _of_kind(table, _DOCUMENT).select(["doc_id", "text"]).to_batches():
        yield from slices(batch)


def _places(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which values are known, which of the known ones each of these is)."""
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    found = np.flatnonzero(known[at] == values)
    return found, at[found]


def _told(marks: DataFrame, texts: DataFrame, window: int, phrase: int) -> DataFrame:
    """segment, shard, words (joined by one space) and both hashes of its windows (null if not asked for), from its owner."""

    def run(shard: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        tell, expand = _keys(table, _TELL), _keys(table, _EXPAND)
        known = np.union1d(tell, expand)
        wanted = np.ones(len(known), bool)
        if not len(known):
            return
        for rows in _texts(table):
            text = _Text(rows.column("text"), window, phrase)
            at, which = _places(text.segment, known)
            which, first = np.unique(which, return_index=True)
            at, which = at[first][wanted[which]], which[wanted[which]]
            wanted[which] = False
            if not len(at):
                continue
            begin, size = text.at[text.begin[at]], text.size[at]
            view = text.data.tobytes()
            starts, ends = text.start.tolist(), text.end.tolist()
            said = [b" ".join([view[starts[i] : ends[i]] for i in range(a, a + m + window - 1)]).decode() for a, m in zip(begin.tolist(), size.tolist(), strict=True)]
            open_ = np.isin(known[which], expand)
            windows = np.repeat(text.begin[at[open_]], size[open_]) + _nth(size[open_])
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.where(open_, size, 0))]), pa.int32())
            hashes = [pa.ListArray.from_arrays(offsets, _signed(text.windows(windows, base)), mask=pa.array(~open_)) for base in (WORD_BASE, OTHER_BASE)]
            yield pa.RecordBatch.from_arrays([_signed(known[which]), pa.array(np.full(len(at), shard), pa.int32()), pa.array(said, pa.string()), *hashes], ["segment", "shard", "words", "keys", "others"])

    wanted = marks.filter(F.col("kind").isin(_TELL, _EXPAND)).withColumn("text", F.lit(None).cast("string"))
    return by_key(_with_documents(wanted, texts), "shard", ["kind"], run, "segment long, shard int, words string, keys array<long>, others array<long>")


def _nth(size: np.ndarray) -> np.ndarray:
    """0 to size - 1 for each size, one after another."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def _passages(marks: DataFrame, told: DataFrame, window: int) -> DataFrame:
    """(shard, text): the passages that each shard needs."""
    holders = marks.filter(F.col("kind") == _SEGMENT).select("shard", F.col("key").alias("segment"))
    whole = holders.join(told.select("segment", "words"), "segment").select("shard", F.col("words").alias("text"))
    pairs = F.arrays_zip(F.col("keys").alias("key"), F.col("others").alias("other"))
    windows = told.filter("keys IS NOT NULL").select("segment", "shard", F.posexplode(pairs).alias("pos", "both")).select("segment", "shard", "pos", "both.key", "both.other")
    twice = windows.groupBy("key", "other").agg(F.count("*").alias("n")).filter("n >= 2").select("key", "other")
    recurring = holders.select("segment").distinct()
    confirmed = windows.join(twice, ["key", "other"], "left_semi").join(recurring, "segment", "left_anti")
    # neighbouring windows of a segment are one run: place minus rank is the same for all of them (a segment has some thirty windows at most)
    ranked = confirmed.withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy("segment").orderBy("pos")))
    ends = [f(F.struct("key", "other"), "pos").alias(name) for name, f in (("first", F.min_by), ("last", F.max_by))]
    runs = keep(ranked.groupBy("segment", "shard", "run").agg(F.min("pos").alias("pos"), F.count("*").alias("size"), *ends), "runs")
    owners = runs.groupBy("first", "last", "size").agg(F.min(F.struct("segment", "pos")).alias("owner"))
    owners = owners.select("first", "last", "size", F.col("owner.segment").alias("segment"), F.col("owner.pos").alias("pos"))
    cut = F.array_join(F.slice(F.split("words", " "), F.col("pos") + 1, (F.col("size") + window - 1).cast("int")), " ")
    said = owners.join(told.select("segment", "words"), "segment").select("first", "last", "size", cut.alias("text"))
    partly = runs.select("shard", "first", "last", "size").distinct().join(said, ["first", "last", "size"]).select("shard", "text")
    return whole.unionByName(partly)


def _symbols(numbers: np.ndarray) -> tuple[int, ...]:
    """Two symbols for each word number: an automaton looks through a node's children one by one, and so no node has more than some hundred."""
    out = np.empty(2 * len(numbers), np.int64)
    out[0::2], out[1::2] = numbers >> 8, (1 << 24) + (numbers & 255)
    return tuple(out.tolist())


def automaton(passages: Iterable[tuple[int, ...]]):
    """One Aho-Corasick automaton over the symbols of words."""
    import ahocorasick

    out = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for passage in passages:
        out.add_word(passage)
    out.make_automaton()
    return out


def _numbers(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """A number for each word of each part (data, starts, ends): equal words, and only these, have equal numbers."""
    columns = []
    for data, start, end in parts:
        size = end - start
        inside = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        columns.append(pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[inside].tobytes())]))
    numbers = pa.chunked_array(columns, pa.large_binary()).combine_chunks()
    numbers = numbers.combine_chunks() if isinstance(numbers, pa.ChunkedArray) else numbers
    flat = numbers.dictionary_encode().indices.to_numpy()
    return np.split(flat, np.cumsum([len(c) for c in columns])[:-1])


def _automata(passages: list[np.ndarray], most: int) -> Iterator:
    """Automata of most words each (a longer passage is one of its own), one at a time."""
    held, size = [], 0
    for passage in passages:
        if held and size + len(passage) > most:
            yield automaton(map(_symbols, held))
            held, size = [], 0
        held.append(passage)
        size += len(passage)
    if held:
        yield automaton(map(_symbols, held))


def _rows(numbers: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    return [numbers[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _cleaned(texts: DataFrame, passages: DataFrame, window: int, automaton_words: int) -> DataFrame:
    def run(shard: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        given = [utf8(batch.column("text")) for batch in _of_kind(table, _PASSAGE).select(["text"]).to_batches()]
        given = [(data, *words(data, offsets), len(offsets) - 1) for data, offsets in given]
        docs = [(rows.column("doc_id"), *utf8(rows.column("text"))) for rows in _texts(table)]
        docs = [(ids, data, *words(data, offsets), len(offsets) - 1) for ids, data, offsets in docs]
        del table
        numbers = _numbers([(d, a, b) for d, a, b, _, _ in given] + [(d, a, b) for _, d, a, b, _, _ in docs])
        needed = [x for known, (_, _, _, row, n) in zip(numbers, given, strict=False) for x in _rows(known, per_row(row, n))]
        numbers = numbers[len(given) :]
        del given
        firsts = [per_row(row, n) for _, _, _, _, row, n in docs]
        gone = [np.zeros(len(start) + 1, np.int64) for _, _, start, _, _, _ in docs]
        for machine in _automata(needed, automaton_words):
            for number, first, change in zip(numbers, firsts, gone, strict=True):
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    if b - a >= window:
                        for last, length in machine.iter(_symbols(number[a:b])):
                            change[a + last // 2 - length // 2 + 1] += 1
                            change[a + last // 2 + 1] -= 1
        for (doc_ids, data, start, end, _, _), first, change in zip(docs, firsts, gone, strict=True):
            # a hit that ends with a document puts its -1 on the next one's first word, where the sum is 0 again
            stay = np.cumsum(change[:-1]) == 0
            kept = np.concatenate([[0], np.cumsum(stay)])[first]
            count = np.diff(first)
            which = np.flatnonzero(stay)
            a, b = start[which].tolist(), end[which].tolist()
            view = data.tobytes()
            out = [b" ".join([view[a[i] : b[i]] for i in range(x, y)]).decode() for x, y in zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(count, pa.int64()), pa.array(count - np.diff(kept), pa.int64()), pa.array(out, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    rows = passages.select("shard", F.lit(_PASSAGE).alias("kind"), F.lit(None).cast("long").alias("key"), "text")
    return by_key(_with_documents(rows, texts), "shard", ["kind"], run, "doc_id long, n_words long, n_removed long, kept string")


def remove_recurring(documents: DataFrame, window: int = WINDOW, phrase: int = PHRASE, automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of each document."""
    texts = _shards(documents)
    segments = keep(_segments(texts, window, phrase), "segments")
    marks = keep(_marks(segments), "marks")
    discard(segments)
    told = keep(_told(marks, texts, window, phrase), "told")
    passages = keep(_passages(marks, told, window), "passages")
    discard(marks)
    discard(told)
    return _cleaned(texts, passages, window, automaton_words)

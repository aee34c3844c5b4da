"""Passages of test items in training documents, also edited ones.

1. Words are runs of letters and digits in lower case, and each letter of a script without blanks (Han, Kana, Thai and the like) is one;
   all else parts them, in any script. An item's groups of GRAM neighbouring words
   are counted in the whole corpus. Groups that occur VERY_RARE times or less, or no more often than the rarer quarter of those of the
   item that occur at all, are very rare (so that an item which stands in a third of all documents has such groups like any
   other). Seeds are the groups that occur at most RARE times as often as these, however many items have them: of items made from
   one template each is sought by the template's groups too.
2. Every document is searched for seeds. Seeds of one item that stand in a document about as they stand in the item make a
   window, if they are two or a very rare one. Smith-Waterman alignment of the item with the window gives the
   score. A matching word counts by how rare it is in the corpus (MATCH on average over the item), others MISMATCH or GAP. The score is
   given as the part of what the item itself would get. A document holds an item if that is at least THRESHOLD and worth
   LEAST_WORDS words (or all of a shorter item). Of passages with the same score the first one is told. A document with a template's words is
   compared with all items of the template; where a row's seeds belong to very many items, these are gone through part by part.

Items are handled in batches of BATCH_BYTES of text at most, one scan of the corpus for counting and one for searching each, and each
batch is done with before the next one begins, so that what is broadcast and what the driver holds have
a bound whatever the number of items. Documents are searched whole, each in its own task.

Null texts hold nothing, and null or wordless items are held by nothing. An item of fewer than MIN_WORDS words can't be told from
ordinary language inside a text: it is held by documents that consist of just these words, or, with short_inside, by those that have them anywhere one
after another. Items with the same words are found
alike, each under its own id. Rows that repeat a doc_id are searched each. Extra columns stay, whatever their names.
Empty tables: no document holds anything.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.llm.common import keep, unused
from loomset.llm.textarray import WORD_BASE, per_row, range_hash, slices, utf8, word_hashes

GRAM = 3
RARE, VERY_RARE = 4, 20
MATCH, MISMATCH, GAP = 4, -1, -1
THRESHOLD = 0.4
LEAST_WORDS = 6
MIN_WORDS = 5
BATCH_BYTES = 8 << 20
#: Windows that are aligned at once, and hits that are handled at once.
ALIGNED, EXPANDED = 2_000, 1 << 20
KNOWN_POINTS = 0x30000
#: The scripts whose letters are words of their own, by the beginnings of Unicode names.
_NO_BLANKS = ("CJK", "HIRAGANA", "KATAKANA", "THAI", "LAO", "KHMER", "MYANMAR", "TIBETAN")


@lru_cache(1)
def _classes() -> np.ndarray:
    """0 parts words, 1 is in a word, 2 is a word, for each code point."""
    out = np.zeros(KNOWN_POINTS + 1, np.uint8)
    out[KNOWN_POINTS] = 2
    for i in range(KNOWN_POINTS):
        c = chr(i)
        if unicodedata.category(c)[0] in "LNM":
            out[i] = 1 + (i >= 0xE00 and unicodedata.name(c, "").startswith(_NO_BLANKS))
    return out


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, first word of each row) of texts in lower case."""
    data, offsets = utf8(column)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    kind = _classes()[np.minimum(points, np.uint32(KNOWN_POINTS))]
    edge = np.zeros(len(points) + 1, bool)
    edge[at] = True
    edge[1:] |= kind == 2
    edge[:-1] |= kind == 2
    inside = np.zeros(len(points) + 2, bool)
    inside[1:-1] = kind > 0
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return word_hashes(points, start, end), per_row(np.searchsorted(at, start, "right") - 1, len(offsets) - 1)


def _grams(word: np.ndarray) -> np.ndarray:
    """Hash of the group that starts at each word; groups may run into the next row."""
    n = len(word) - GRAM + 1
    return range_hash(word, np.arange(n), np.arange(n) + GRAM, WORD_BASE) if n > 0 else np.zeros(0, np.uint64)


class _Among:
    """Which of many hashes are among some: a bit table rules out nearly all."""

    def __init__(self, known: np.ndarray):
        self.known = np.unique(known)
        self.shift = np.uint64(64 - 22)
        self.table = np.zeros(1 << 22, bool)
        self.table[(self.known >> self.shift).astype(np.int64)] = True

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where a known hash stands, which one)."""
        at = np.flatnonzero(self.table[(hashes >> self.shift).astype(np.int64)])
        if not len(at) or not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        which = np.minimum(np.searchsorted(self.known, hashes[at]), len(self.known) - 1)
        same = self.known[which] == hashes[at]
        return at[same], which[same]


class Items:
    """Items of one batch: words, groups, and seeds and weights once the corpus has been counted."""

    def __init__(self, ids: list[int], texts: list[str], short_inside: bool = False):
        self.short_inside = short_inside
        word, first = _words(pa.array(texts, pa.string()))
        same: dict[bytes, list[int]] = {}
        for one, a, b in zip(ids, first[:-1].tolist(), first[1:].tolist(), strict=True):
            if a < b:
                same.setdefault(word[a:b].tobytes(), []).append(one)
        self.ids = list(same.values())  # of the items that have these words
        self.words = [np.frombuffer(x, np.uint64) for x in same]
        self.short = {x: i for i, x in enumerate(same) if len(x) < 8 * MIN_WORDS}
        self.length = np.array([len(w) for w in self.words], np.int64)
        grams = [_grams(w) if len(w) >= MIN_WORDS else w[:0] for w in self.words]
        self.gram = np.concatenate([*grams, np.zeros(0, np.uint64)])
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        self.offset = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)]).astype(np.int64)
        self.among = _Among(self.gram)
        self.vocabulary = _Among(np.concatenate([*self.words, np.zeros(0, np.uint64)]))

    def counted(self) -> int:
        """How many numbers choose() wants: of each group, of each word, and of all words."""
        return len(self.among.known) + len(self.vocabulary.known) + 1

    def count(self, column: pa.Array, counts: np.ndarray) -> None:
        """Adds what some texts have."""
        word, first = _words(column)
        at, which = self.among.places(_grams(word))
        inside = at + GRAM <= first[np.searchsorted(first, at, "right")] if len(at) else np.zeros(0, bool)
        groups = len(self.among.known)
        counts[:groups] += np.bincount(which[inside], minlength=groups)
        counts[groups:-1] += np.bincount(self.vocabulary.places(word)[1], minlength=len(self.vocabulary.known))
        counts[-1] += len(word)

    def choose(self, counts: np.ndarray) -> None:
        """Seeds, what each of them counts, and the weights of words."""
        groups = len(self.among.known)
        often = counts[:groups][np.searchsorted(self.among.known, self.gram)]
        order = np.lexsort((self.offset, often, self.item))
        item, often = self.item[order], often[order]
        zeros = np.searchsorted(2 * item + (often > 0), 2 * item + 1)  # where the groups begin that occur at all
        stop = np.searchsorted(item, item, "right")
        quarter = np.maximum(often[np.minimum(zeros + (stop - zeros) // 4, stop - 1)], VERY_RARE) if len(order) else often
        rare = often <= RARE * quarter
        take, point = order[rare], np.where(often <= quarter, 2, 1)[rare]
        by_gram = np.argsort(self.gram[take], kind="stable")
        take, self.point = take[by_gram], point[by_gram]
        self.gram, self.item, self.offset = self.gram[take], self.item[take], self.offset[take]
        self.among = _Among(self.gram)
        self.begin = np.searchsorted(self.gram, self.among.known)
        self.end = np.searchsorted(self.gram, self.among.known, "right")
        # seeds of a group are in the order of their items, so this ascends
        self.key = np.searchsorted(self.among.known, self.gram) * max(1, len(self.ids)) + self.item
        rarity = np.log((counts[-1] + 2) / (counts[groups:-1] + 1))
        self.weights = []
        for words in self.words:
            own = rarity[np.searchsorted(self.vocabulary.known, words)] + 0.1
            self.weights.append(np.maximum(1, np.rint(own * MATCH / own.mean())).astype(np.int32))
        self.full = np.array([w.sum() for w in self.weights], np.int64)
        del self.vocabulary


def align(items: list[np.ndarray], windows: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(Smith-Waterman scores, where in the window the best alignment ends) of pairs of word sequences. weights: of each item's words."""
    best = np.zeros(len(items), np.int32)
    end = np.zeros(len(items), np.int64)
    order = np.lexsort(([len(x) for x in items], [len(x) for x in windows]))
    at = 0
    while at < len(order):
        # fewer at once if they are long
        some = order[at : at + ALIGNED]
        widths = np.array([len(windows[i]) for i in some])
        some = some[: max(1, int(np.searchsorted(widths * np.arange(1, len(some) + 1), 200 * ALIGNED)))]
        at += len(some)
        wide, high = max(len(windows[i]) for i in some), max(len(items[i]) for i in some)
        # 0 pads items and 1 pads windows: they match nothing
        left, right = np.zeros((len(some), high), np.uint64), np.ones((len(some), wide), np.uint64)
        value = np.zeros((len(some), high), np.int32)
        for k, i in enumerate(some.tolist()):
            left[k, : len(items[i])] = items[i]
            value[k, : len(items[i])] = weights[i]
            right[k, : len(windows[i])] = windows[i]
        slope = -GAP * np.arange(wide + 1, dtype=np.int32)
        score = np.zeros((len(some), wide + 1), np.int32)
        top, where = np.zeros(len(some), np.int32), np.zeros(len(some), np.int64)
        for j in range(high):
            now = np.maximum(score + GAP, 0)
            np.maximum(now[:, 1:], score[:, :-1] + np.where(right == left[:, j : j + 1], value[:, j : j + 1], np.int32(MISMATCH)), out=now[:, 1:])
            score = np.maximum.accumulate(now + slope, axis=1) - slope
            spot = score.argmax(1)
            reached = score[np.arange(len(some)), spot]
            more = reached > top
            top[more], where[more] = reached[more], spot[more]
        best[some], end[some] = top, where
    return best, end


_Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _no_find() -> _Found:
    none = np.zeros(0, np.int64)
    return none, none, np.zeros(0), none, none


def _short_held(word: np.ndarray, first: np.ndarray, items: Items) -> _Found:
    """Items of a few words that are all of a row, or stand anywhere in it."""
    size = np.diff(first)
    hits = []
    for n in sorted({len(x) // 8 for x in items.short}):
        if items.short_inside:
            begins = np.arange(max(0, len(word) - n + 1))
            known = {range_hash(np.frombuffer(x, np.uint64), np.zeros(1, np.int64), np.array([n]), WORD_BASE)[0] for x in items.short if len(x) == 8 * n}
            at = begins[np.isin(range_hash(word, begins, begins + n, WORD_BASE), np.array(sorted(known), np.uint64))] if len(begins) else begins
            rows = np.searchsorted(first, at, "right") - 1
        else:
            rows = np.flatnonzero(size == n)
            at = first[rows]
        for a, r in zip(at.tolist(), rows.tolist(), strict=True):
            if a + n <= first[r + 1] and (item := items.short.get(word[a : a + n].tobytes())) is not None:
                hits.append((r, item, a - first[r], n))
    if not hits:
        return _no_find()
    once: dict[tuple[int, int], tuple[int, int]] = {}
    for r, item, a, n in hits:
        once.setdefault((r, item), (a, n))
    row, item, start, n = (np.array(x, np.int64) for x in zip(*((r, i, a, n) for (r, i), (a, n) in once.items()), strict=True))
    return row, item, np.ones(len(row)), start, start + n


def _seeded(word: np.ndarray, first: np.ndarray, at: np.ndarray, which: np.ndarray, row: np.ndarray, items: Items, some: tuple[int, int]) -> _Found:
    """The finds of hits, as far as they are of items in the range `some`."""
    base = which * max(1, len(items.ids))
    begin, end = np.searchsorted(items.key, base + some[0]), np.searchsorted(items.key, base + some[1])
    many = end - begin
    spread = np.repeat(np.arange(len(at)), many)
    seed = np.arange(len(spread)) - np.repeat(np.cumsum(many) - many, many) + begin[spread]
    row, item, origin, point = row[spread], items.item[seed], at[spread] - items.offset[seed], items.point[seed]
    if not len(row):
        return _no_find()
    order = np.lexsort((origin, item, row))
    row, item, origin = row[order], item[order], origin[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (origin[1:] - origin[:-1] > items.length[item[1:]] // 2)
    begin = np.flatnonzero(new)
    final = np.append(begin[1:], len(row)) - 1
    enough = np.add.reduceat(point[order], begin) >= 2
    begin, final = begin[enough], final[enough]
    row, item = row[begin], item[begin]
    length = items.length[item]
    low = np.maximum(origin[begin] - length // 3, first[row])
    high = np.minimum(origin[final] + length + length // 3, first[row + 1])
    own, weights = [items.words[i] for i in item.tolist()], [items.weights[i] for i in item.tolist()]
    score, end = align(own, [word[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)], weights)
    part = score / items.full[item]
    good = np.flatnonzero((part >= THRESHOLD) & (score * length >= items.full[item] * np.minimum(length, LEAST_WORDS)))
    if not len(good):
        return _no_find()
    # the same alignment from its end backwards tells where it begins
    stop = low[good] + end[good]
    backwards = [word[a:b][::-1] for a, b in zip(low[good].tolist(), stop.tolist(), strict=True)]
    _, back = align([own[i][::-1] for i in good.tolist()], backwards, [weights[i][::-1] for i in good.tolist()])
    row, item, part, start, stop = row[good], item[good], part[good], stop - back - first[row[good]], stop - first[row[good]]
    order = np.lexsort((start, -part, item, row))
    row, item, part, start, stop = row[order], item[order], part[order], start[order], stop[order]
    best = np.ones(len(row), bool)
    best[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
    return row[best], item[best], part[best], start[best], stop[best]


def _held(column: pa.Array, items: Items) -> _Found:
    """(row, item, score, start, end) for each item that a row holds; start and end count the row's words around the passage."""
    word, first = _words(column)
    at, which = items.among.places(_grams(word))
    row = np.searchsorted(first, at, "right") - 1
    whole = at + GRAM <= first[row + 1]
    at, which, row = at[whole], which[whole], row[whole]
    found = [_short_held(word, first, items)]
    # as many rows at once as EXPANDED allows, one at least; then that row's items part by part
    many = items.end[which] - items.begin[which]
    load = np.cumsum(many) // EXPANDED
    block = load[np.searchsorted(row, row)]
    for k in np.unique(block):
        mine = block == k
        parts = int(-(-many[mine].sum() // EXPANDED)) if (row[mine] == row[mine][0]).all() else 1
        edges = np.linspace(0, len(items.ids), parts + 1).astype(np.int64)
        for some in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            found.append(_seeded(word, first, at[mine], which[mine], row[mine], items, some))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _batches(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """Items with text, and in how many batches of BATCH_BYTES at most they are handled (halves, as they are dealt by hash)."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.col("text").cast("string")).alias("text")).filter("text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return rows, max(1, -(-2 * total // BATCH_BYTES))


def _lowered(documents: DataFrame) -> DataFrame:
    return documents.select(F.lower(F.col("text").cast("string")).alias("text"))


def learn(documents: DataFrame, rows: DataFrame, batches: int, batch: int, short_inside: bool = False) -> Items:
    """The items of one batch with seeds and weights from how often groups and words occur in all documents."""
    mine = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(batches)) == batch).toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
    items = Items(mine.column("item_id").to_pylist(), mine.column("text").to_pylist(), short_inside)
    counts = np.zeros(items.counted(), np.int64)
    if len(items.ids):
        shared = documents.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros(shared.value.counted(), np.int64)
            for batch in batches:
                for rows in slices(batch):
                    shared.value.count(rows.column("text"), held)
            full = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(held[full])], ["which", "n"])

        # one row for each group and word of the batch at most
        for r in _lowered(documents).mapInArrow(run, "which long, n long").groupBy("which").agg(F.sum("n").alias("n")).toArrow().to_batches():
            counts[r.column("which").to_numpy()] = r.column("n").to_numpy()
        shared.destroy()
    items.choose(counts)
    return items


def _shared(documents: DataFrame, rows: DataFrame, batches: int, short_inside: bool) -> Iterator[Broadcast]:
    """Each batch for the tasks, to be destroyed when it is done with."""
    for batch in range(batches):
        yield documents.sparkSession.sparkContext.broadcast(learn(documents, rows, batches, batch, short_inside))


def held_items(documents: DataFrame, benchmark: DataFrame, short_inside: bool = False) -> DataFrame:
    """doc_id, item_id, score, and start and end of the passage in the document's words, for each item that a document holds."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))
    out = None
    for shared in _shared(documents, *_batches(benchmark), short_inside):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids = shared.value.ids
            for batch in batches:
                for rows in slices(batch):
                    row, item, score, start, end = _held(rows.column("text"), shared.value)
                    many = np.array([len(ids[i]) for i in item.tolist()], np.int64)
                    each = np.repeat(np.arange(len(item)), many)
                    named = [x for i in item.tolist() for x in ids[i]]
                    yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(row[each])), pa.array(named, pa.int64()), pa.array(score[each]), pa.array(start[each]), pa.array(end[each])], ["doc_id", "item_id", "score", "start", "end"])

        found = keep(texts.mapInArrow(run, "doc_id long, item_id long, score double, start long, end long"), "held")
        shared.destroy()
        out = found if out is None else out.union(found)
    return out


def clean(documents: DataFrame, benchmark: DataFrame, short_inside: bool = False) -> DataFrame:
    """The documents that hold no item, all columns as they are."""
    schema, out, lower = documents.schema, documents, unused(documents, "_lower")
    rows, batches = _batches(benchmark)
    for k, shared in enumerate(_shared(documents, rows, batches, short_inside), 1):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows in slices(batch, lower):
                    stay = np.ones(rows.num_rows, bool)
                    stay[_held(rows.column(lower), shared.value)[0]] = False
                    yield rows.drop_columns([lower]).filter(pa.array(stay))

        out = out.withColumn(lower, F.lower(F.col("text").cast("string"))).mapInArrow(run, schema)
        if k < batches:  # the last batch is done with when the result is read
            out = keep(out, "clean")
            shared.destroy()
    return out

"""Language of texts, and of the spans of mixed ones.

Learning. For each language, how often each group of three neighbouring characters occurs (letters in lower case; all that is
no letter is one mark, so that word beginnings and ends count), in 2**HASH_BITS hashed cells, and how many letters of
each script it has. One pass over all labelled texts; each task adds up its own counts and hands them on whenever it holds
HELD languages, so that a table of languages x cells is all that is dealt out and all that the driver gets, however large the corpus.

Use. Words are runs of letters, cut after WORD_LETTERS (scripts without blanks have long runs). The scripts of a word's letters narrow
the languages it may be in: a script in which a language has less than MIN_SHARE of its
letters rules that language out (unless it rules out all). A word's score for a language is the sum of the logarithms of its groups'
probabilities, at most WORD_CAP away from the best language's, so that no single odd word decides. The Viterbi path over the words of a
text with a penalty for each switch labels spans. A text's language is that with the most letters on the path; its
score is their share of all letters, times how sure the text's mean margin over the second language makes it.

Memory. A model takes 256 kB for each language. Texts are judged in slices of SLICE bytes (less for many languages). A longer text is
read in pieces, cut at white space where there is some (else between two characters), and its path runs through all of them: of each
word only its place, the best language before it and a bit for each language are held. Texts are never cut short.

A text that is null or has no letter is `und`, with score 0. If nothing can be learned (no labelled texts), all are `und`. Of languages
that are equally good the first in the alphabet is taken. Rows are judged one by one, so repeated ids or rows need nothing. All
columns stay; where the input has columns named like the new ones, these get `_` in front (`common.unused`).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from loomset.llm.common import unused
from loomset.llm.textarray import slices, utf8

HASH_BITS = 16
CELLS = 1 << HASH_BITS
PENALTY = 8.0
WORD_CAP = 12.0
WORD_LETTERS = 64
MIN_SHARE = 0.01
SMOOTHING = 0.5
#: Code points beyond this one count as letters of the last script by their category only.
KNOWN_POINTS = 0x30000
#: Bytes of text that are worked on at once, and letters x languages that are scored at once.
SLICE, SCORED = 1 << 19, 1 << 21
#: Languages whose counts a task holds at once.
HELD = 32
#: Below so many texts, steps are taken one by one; in plain numbers if languages are few. All ways take the same steps in double precision.
FEW, FEW_LANGUAGES = 6, 12

UNKNOWN = "und"
#: Where the letters of each script begin and end (code points).
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x77F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FFFF)),
}
OTHER = len(SCRIPTS)


@lru_cache(1)
def _points() -> tuple[np.ndarray, np.ndarray]:
    """(lower-case letter or 0, script) of each code point."""
    lower = np.zeros(KNOWN_POINTS, np.uint32)
    for i in range(KNOWN_POINTS):
        c = chr(i)
        if c.isalpha() or unicodedata.category(c)[0] == "M":
            low = c.lower()
            lower[i] = ord(low) if len(low) == 1 else i
    script = np.full(KNOWN_POINTS, OTHER, np.uint8)
    for k, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            script[a : b + 1] = k
    return lower, script


class _Words:
    """Words of some texts that lie one after another, with the hashed groups and the scripts of their letters."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        self.at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])[offsets]  # texts, in code points
        points = np.minimum(points, np.uint32(KNOWN_POINTS - 1))
        lower, script = _points()
        low = np.zeros(len(points) + 2, np.uint32)
        low[1:-1] = lower[points]
        letter = np.flatnonzero(low[1:-1]).astype(np.int32)
        edge = np.zeros(len(points) + 1, bool)
        edge[self.at] = True
        starts = edge[letter]
        mixed = low[letter].astype(np.uint64)
        mixed[starts] = 0
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed += low[letter + 1]
        mixed *= np.uint64(0xD1342543DE82EF95)
        after = low[letter + 2].astype(np.uint64)
        after[edge[letter + 1]] = 0
        after *= np.uint64(0xA0761D6478BD642F)
        mixed += after
        del after, low
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed >>= np.uint64(64 - HASH_BITS)
        self.group = mixed.astype(np.int32)
        self.script = script[points[letter]]
        new = starts
        new[1:] |= letter[1:] != letter[:-1] + 1
        new[:1] = True
        run = np.flatnonzero(new)
        size = np.diff(np.append(run, len(letter)))
        new |= (np.arange(len(letter)) - np.repeat(run, size)) % WORD_LETTERS == 0
        self.first_letter = np.searchsorted(letter, self.at)  # of each text
        self.word = np.flatnonzero(new)  # first letter of each word
        self.length = np.diff(np.append(self.word, len(letter)))
        self.start = letter[self.word].astype(np.int64)  # in code points
        self.row = np.searchsorted(self.at, self.start, "right") - 1
        self.first = np.searchsorted(self.row, np.arange(len(offsets)))  # words of each text


def _cuts(data: np.ndarray) -> list[int]:
    """Where the pieces of a long text begin, and its end."""
    out = [0]
    while len(data) - out[-1] > SLICE:
        half, end = out[-1] + SLICE // 2, out[-1] + SLICE
        blank = np.flatnonzero(data[half:end] <= 0x20)
        if len(blank):
            end = half + int(blank[-1]) + 1
        else:
            while (data[end] & 0xC0) == 0x80:
                end -= 1
        out.append(end)
    return [*out, len(data)]


def _pieces(column: pa.Array) -> Iterator[_Words]:
    """The words of a slice; of a single long text piece by piece."""
    data, offsets = utf8(column)
    if len(offsets) > 2 or len(data) <= SLICE:
        yield _Words(data, offsets)
        return
    cuts = _cuts(data)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield _Words(data[a:b], np.array([0, b - a]))


def counts(texts: DataFrame) -> DataFrame:
    """lang, cell and n. Cells from CELLS on are letters of scripts. texts: text, lang."""

    def told(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, now in held.items():
            full = np.flatnonzero(now)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(full), pa.string()), pa.array(full, pa.int32()), pa.array(now[full])], ["lang", "cell", "n"])
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for rows in slices(batch.sort_by("lang"), limit=SLICE):
                langs = rows.column("lang").to_pylist()
                new = [i for i, x in enumerate(langs) if not i or x != langs[i - 1]]
                for words in _pieces(rows.column("text")):
                    for i, j in zip(new, [*new[1:], len(langs)], strict=True):
                        if langs[i] not in held and len(held) == HELD:
                            yield from told(held)
                        now = held.setdefault(langs[i], np.zeros(CELLS + OTHER + 1, np.int64))
                        a, b = words.first_letter[i], words.first_letter[j]
                        now[:CELLS] += np.bincount(words.group[a:b], minlength=CELLS)
                        now[CELLS:] += np.bincount(words.script[a:b], minlength=OTHER + 1)
        yield from told(held)

    return texts.select("text", "lang").mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


class Model:
    def __init__(self, langs: list[str], table: np.ndarray, allowed: np.ndarray):
        self.langs, self.table, self.allowed = langs, table, allowed


def learn(labelled: DataFrame) -> Model:
    """Learns from texts with a lang; rows without either teach nothing. What it collects is one row for each language and used cell."""
    texts = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    found = counts(texts).toArrow()
    names = found.column("lang").combine_chunks().dictionary_encode()
    if isinstance(names, pa.ChunkedArray):
        names = names.combine_chunks()
    langs = sorted(names.dictionary.to_pylist())
    order = {x: i for i, x in enumerate(langs)}
    place = np.array([order[x] for x in names.dictionary.to_pylist()], np.int64)
    have = np.zeros((CELLS + OTHER + 1, len(langs)))
    if len(langs):
        have[found.column("cell").to_numpy(), place[names.indices.to_numpy()]] = found.column("n").to_numpy()
    scripts = have[CELLS:].copy()
    table = have[:CELLS]
    total = table.sum(0) + SMOOTHING * CELLS
    table += SMOOTHING
    table /= total
    np.log(table, out=table)
    allowed = scripts >= MIN_SHARE * np.maximum(scripts.sum(0), 1)
    allowed[~allowed.any(1)] = True
    return Model(langs, table.astype(np.float32), allowed)


def _word_scores(words: _Words, model: Model) -> np.ndarray:
    n, k = len(words.word), len(model.langs)
    scores = np.zeros((n, k), np.float32)
    if not n:
        return scores
    scripts, which = np.unique(np.bitwise_or.reduceat(np.int32(1) << words.script.astype(np.int32), words.word), return_inverse=True)
    used = (scripts[:, None] >> np.arange(OTHER + 1)) & 1
    ruled_out = used @ (~model.allowed).astype(np.int64) > 0
    ruled_out[ruled_out.all(1)] = False
    block = max(1, SCORED // k)
    cuts = np.unique(np.append(np.searchsorted(words.word, np.arange(0, len(words.group), block)), n))
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        a = words.word[i]
        b = words.word[j] if j < n else len(words.group)
        some = np.add.reduceat(model.table[words.group[a:b]], words.word[i:j] - a, axis=0)
        out = ruled_out[which[i:j]]
        some[out] = -np.inf
        some -= some.max(1, keepdims=True)
        scores[i:j] = np.maximum(some, np.where(out, np.float32(-2 * WORD_CAP), np.float32(-WORD_CAP)))
    return scores


def _walk(now: np.ndarray, scores: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values after the last word, which languages stay at each word, the language that the others come from), for one text."""
    n, k = scores.shape
    stay, top = np.zeros((n, k), bool), np.zeros(n, np.int32)
    now = np.asarray(now, np.float64)
    if k <= FEW_LANGUAGES and n:
        now, stays, tops = now.tolist(), [], []
        for row in scores.tolist():
            high = max(now)
            tops.append(now.index(high))
            now = [x - high for x in now]
            stays.append([x >= -penalty for x in now])
            now = [(x if x >= -penalty else -penalty) + y for x, y in zip(now, row, strict=True)]
        return np.array(now), np.array(stays), np.array(tops, np.int32)
    for u in range(n):
        top[u] = now.argmax()
        now = now - now[top[u]]
        np.greater_equal(now, -penalty, out=stay[u])
        now = np.maximum(now, -penalty) + scores[u]
    return now, stay, top


def _back(state: int, stay: np.ndarray, top: np.ndarray) -> tuple[int, np.ndarray]:
    """(the language before the first word, those before each word) of a path that ends in state."""
    out = np.zeros(len(top), np.int32)
    tops = top.tolist()
    for u in range(len(tops) - 1, -1, -1):
        if not stay[u, state]:
            state = tops[u]
        out[u] = state
    return state, out


def _path(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word: texts are the rows first[i]:first[i + 1] of scores, and all of them take their nth step at once."""
    n, k = scores.shape
    out = np.zeros(n, np.int32)
    if k < 2 or not n:
        return out
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, size = first[:-1][order], size[order]
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")  # texts with more than t words
    stay, top = np.zeros((n, k), bool), np.zeros(n, np.int32)
    best = scores[start[: active[0]]].astype(np.float64)
    ends = best.copy()
    every = np.arange(active[0])
    t = 1
    while t < size[0] and active[t] >= FEW:
        a = active[t]
        best = best[:a]
        high = best.argmax(1)
        best = best - best[every[:a], high][:, None]
        at = start[:a] + t
        stay[at], top[at] = best >= -penalty, high
        best = np.maximum(best, -penalty) + scores[at]
        ends[:a] = best
        t += 1
    few = active[t] if t < size[0] else 0  # the longest ones go on alone from their t-th word
    state = np.zeros(active[0], np.int32)
    for i in range(few):
        rest = slice(start[i] + t, start[i] + size[i])
        ends[i], stay[rest], top[rest] = _walk(ends[i], scores[rest], penalty)
    state[:] = ends.argmax(1)
    for i in range(few):
        out[start[i] + size[i] - 1] = state[i]
        rest = slice(start[i] + t, start[i] + size[i])
        state[i], before = _back(int(state[i]), stay[rest], top[rest])
        out[start[i] + t - 1 : start[i] + size[i] - 1] = before
    for u in range(t - 1, -1, -1):
        a = active[u]
        at = start[:a] + u
        out[at] = state[:a]
        if u:
            state[:a] = np.where(stay[at, state[:a]], state[:a], top[at])
    return out


@dataclass
class _Judged:
    row: np.ndarray  # of each word
    start: np.ndarray  # in code points of its text
    length: np.ndarray
    path: np.ndarray
    total: np.ndarray  # sum of the scores of each text's words


def _judge(column: pa.Array, model: Model, penalty: float) -> _Judged:
    n, k = len(column), len(model.langs)
    pieces = _pieces(column)
    words = next(pieces)
    scores = _word_scores(words, model)
    after = next(pieces, None)
    if after is None:
        total = np.zeros((n, k))
        full = np.flatnonzero(np.diff(words.first))
        if len(full):
            total[full] = np.add.reduceat(scores, words.first[full], axis=0, dtype=np.float64)
        return _Judged(words.row, words.start - words.at[words.row], words.length, _path(scores, words.first, penalty), total)
    now, total, base = None, np.zeros(k), 0
    starts, lengths, steps = [], [], []
    while words is not None:
        starts.append(words.start + base)
        lengths.append(words.length)
        total += scores.sum(0, dtype=np.float64)
        if len(scores):
            begun = now is not None
            now, stay, top = _walk(now if begun else scores[0], scores if begun else scores[1:], penalty)
            steps.append((np.packbits(stay, axis=1), top, begun))
        base += int(words.at[-1])
        words, after = after, next(pieces, None)
        scores = _word_scores(words, model) if words is not None else None
    path: list[np.ndarray] = []
    if now is not None:
        state = int(now.argmax())
        path.append(np.array([state], np.int32))
        for bits, top, _ in reversed(steps):
            state, before = _back(state, np.unpackbits(bits, axis=1, count=k).astype(bool), top)
            path.append(before)
    start = np.concatenate(starts)
    return _Judged(np.zeros(len(start), np.int64), start, np.concatenate(lengths), np.concatenate([*reversed(path), np.zeros(0, np.int32)]), total[None])


def _limit(model: Model) -> int:
    """Bytes of a slice: fewer if there are many languages."""
    return max(1 << 14, SLICE * 8 // max(8, len(model.langs)))


def predict(documents: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """All columns of documents with lang_pred and score. documents: text and more."""
    pred_name, score_name = unused(documents, "lang_pred"), unused(documents, "score")
    documents = documents.withColumn("text", F.col("text").cast("string"))
    langs = model.langs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, limit=_limit(model)):
                n, k = rows.num_rows, len(langs)
                pred, sure = [UNKNOWN] * n, np.zeros(n)
                if k:
                    found = _judge(rows.column("text"), model, penalty)
                    share = np.bincount(found.row * k + found.path, weights=found.length, minlength=n * k).reshape(n, k)
                    have = share.sum(1)
                    best = share.argmax(1)
                    mean = found.total / np.maximum(np.bincount(found.row, minlength=n), 1)[:, None]
                    own = mean[np.arange(n), best]
                    mean[np.arange(n), best] = -np.inf
                    margin = own - mean.max(1) if k > 1 else np.full(n, WORD_CAP)
                    sure = share[np.arange(n), best] / np.maximum(have, 1) / (1 + np.exp(np.clip(-2 * margin, -30, 30)))
                    sure = np.where(have > 0, np.clip(sure, 0, 1), 0)
                    pred = [langs[b] if h else UNKNOWN for b, h in zip(best.tolist(), have.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(pred, pa.string()), pa.array(sure, pa.float64())], [*rows.schema.names, pred_name, score_name])

    return documents.mapInArrow(run, StructType([*documents.schema, StructField(pred_name, StringType()), StructField(score_name, DoubleType())]))


def spans(documents: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """doc_id, start, end (code points) and lang of each span of one language, in the order of the text."""
    langs = model.langs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, limit=_limit(model)):
                found = _judge(rows.column("text"), model, penalty)
                n = len(found.path)
                if not n or not langs:
                    continue
                new = np.ones(n, bool)
                new[1:] = (found.path[1:] != found.path[:-1]) | (found.row[1:] != found.row[:-1])
                begin = np.flatnonzero(new)
                final = np.append(begin[1:], n) - 1
                stop = found.start[final] + found.length[final]
                names = pa.array([langs[x] for x in found.path[begin].tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(found.row[begin])), pa.array(found.start[begin]), pa.array(stop), names], ["doc_id", "start", "end", "lang"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, end long, lang string")


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text, modulo 4, is 2; rows without an id are not held out, and nothing is learned from them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def training(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("doc_id").isNotNull() & ~held_out())


def languages(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from those that are not held out."""
    model = learn(training(documents))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return predict(rows, model).drop("text")

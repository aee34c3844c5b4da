"""Token ids of whole texts by the tokenizers library, many texts at once.

Ids are those of `Tokenizer.from_file(path).encode(text, add_special_tokens=False)`: nothing is put around a text, and the strings
of added tokens in it (such as <|endoftext|>) are these tokens.

A byte-level file without normaliser first splits a text into short pieces (a word with its leading space, a run of
digits, a run of signs, white space) and then merges inside each piece, so ids of a piece do not
depend on where it stands. Pieces are found with vector operations, each distinct piece is given to
the tokenizer's model once, and a bounded store keeps text and ids of the pieces seen by this worker, those met again in preference; what the store says is
compared with the text. Texts with apostrophes, letters beyond the Greek and Cyrillic blocks or strings of added tokens go to the
tokenizer whole, and so do all texts if the file is of another kind.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Sequence
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa

from loomset.llm.textarray import BYTE_BASE, range_hash, utf8

#: Code points below this one, apart from the apostrophe, are split here.
PLAIN_BELOW = 0x500
#: Pieces whose ids a worker keeps, and code points of them. Beyond that those stay that were met again, up to half of it.
KEPT_PIECES, KEPT_POINTS = 800_000, 1 << 24
#: Pieces that are added to a table of their own first, so that adding doesn't move all that is kept.
LATE_PIECES = 50_000
#: Text that is encoded at once: what an encoder holds besides is some hundred bytes for each character of it.
TEXT_BYTES = 1 << 19


def _classes() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 other, 9 not handled here."""
    out = np.full(PLAIN_BELOW + 1, 3, np.uint8)
    for i in range(PLAIN_BELOW):
        kind = unicodedata.category(chr(i))[0]
        out[i] = {"L": 1, "N": 2}.get(kind, 3)
    out[[0x20, *range(0x09, 0x0E), 0x85, 0xA0]] = 0
    out[[0x27, PLAIN_BELOW]] = 9
    return out


def _byte_letters() -> str:
    """The letter that byte-level vocabularies write for each byte: itself if it can be seen, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return "".join(chr(b) if b in seen else chr(next(spare)) for b in range(256))


def _splits_in_pieces(file: dict) -> bool:
    """Whether a tokenizer file splits texts the way that is done here."""
    split, model = file.get("pre_tokenizer") or {}, file.get("model") or {}
    byte_level = split.get("type") == "ByteLevel" and not split.get("add_prefix_space", True) and split.get("use_regex", True)
    plain_model = model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    return bool(byte_level and plain_model) and not any(file.get(x) for x in ("normalizer", "truncation", "padding"))


class Encoder:
    """Ids of texts by one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        file = json.loads(Path(path).read_text(encoding="utf-8"))
        self.whole = Tokenizer.from_file(path)
        self.in_pieces = _splits_in_pieces(file)
        self.added = [x["content"] for x in file.get("added_tokens") or [] if x["content"]]
        self.added_with_space = any(" " in x["content"] or x.get("lstrip") or x.get("rstrip") for x in file.get("added_tokens") or [])
        self.model = self.whole.model
        self.classes = _classes()
        self.letters = dict(enumerate(_byte_letters()))
        self.clear()

    def clear(self) -> None:
        self.kept = 0
        self.old = self.late = (np.zeros(0, np.uint64), np.zeros(0, np.int32))  # sorted hashes of the pieces kept, and their numbers
        self.begin, self.said_at = np.zeros(1, np.int32), np.zeros(1, np.int32)  # of a piece's ids and text, by number; the next piece's follow
        self.again = np.zeros(0, bool)  # whether a piece was met again, by number
        self.pool, self.said = np.zeros(1 << 18, np.uint32), np.zeros(1 << 18, np.uint32)

    @staticmethod
    def _put(pool: np.ndarray, used: int, values: np.ndarray) -> np.ndarray:
        if used + len(values) > len(pool):
            pool = np.concatenate([pool, np.zeros(max(len(values), len(pool) // 2), pool.dtype)])
        pool[used : used + len(values)] = values
        return pool

    @staticmethod
    def _merged(kept: tuple[np.ndarray, np.ndarray], more: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(kept[0], more[0])
        return np.insert(kept[0], at, more[0]), np.insert(kept[1], at, more[1])

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, -1 where there is none."""
        out = np.full(len(keys), -1, np.int32)
        for have, numbers in (self.old, self.late):
            if len(have):
                at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                here = np.flatnonzero(have[at] == keys)
                out[here] = numbers[at[here]]
        return out

    def _add(self, keys: np.ndarray, pieces: list[str]) -> np.ndarray:
        """Numbers of new pieces. keys: sorted, none of them kept so far."""
        tokenize = self.model.tokenize
        spelt = b"\xff".join([x.encode() for x in pieces]).decode("latin-1").translate(self.letters)  # no UTF-8 text has the byte 0xFF
        ids = [[t.id for t in tokenize(x)] for x in spelt.split(self.letters[0xFF])]
        count, size = np.array([len(x) for x in ids], np.int32), np.array([len(x) for x in pieces], np.int32)
        flat = np.array(list(chain.from_iterable(ids)), np.uint32)
        said = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        n = self.kept
        self.pool, self.said = self._put(self.pool, int(self.begin[n]), flat), self._put(self.said, int(self.said_at[n]), said)
        self.begin = self._put(self.begin, n + 1, self.begin[n] + np.cumsum(count, dtype=np.int32))
        self.said_at = self._put(self.said_at, n + 1, self.said_at[n] + np.cumsum(size, dtype=np.int32))
        self.again = self._put(self.again, n, np.zeros(len(keys), bool))
        self.kept = n + len(keys)
        numbers = np.arange(n, self.kept, dtype=np.int32)
        self.late = self._merged(self.late, (keys, numbers))
        if len(self.late[0]) > LATE_PIECES:
            self.old, self.late = self._merged(self.old, self.late), (keys[:0], numbers[:0])
        return numbers

    def _sweep(self) -> None:
        """Of the pieces met again since the last time the first ones stay, up to half of what is kept at most."""
        n = self.kept
        count, size, stay = np.diff(self.begin[: n + 1]), np.diff(self.said_at[: n + 1]), self.again[:n]
        stay &= (np.cumsum(stay) <= KEPT_PIECES // 2) & (np.cumsum(size * stay, dtype=np.int64) <= KEPT_POINTS // 2)
        keys, numbers = self._merged(self.old, self.late)
        here = stay[numbers]
        self.old, self.late = (keys[here], (np.cumsum(stay, dtype=np.int32) - 1)[numbers[here]]), (keys[:0], numbers[:0])
        self.pool, self.said = self.pool[: self.begin[n]][np.repeat(stay, count)], self.said[: self.said_at[n]][np.repeat(stay, size)]
        self.begin, self.said_at = (np.concatenate([[0], np.cumsum(x[stay])]).astype(np.int32) for x in (count, size))
        self.kept = int(stay.sum())
        self.again = np.zeros(self.kept, bool)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.whole.encode_batch(texts, add_special_tokens=False)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): ids of row i are ids[offsets[i]:offsets[i + 1]]; null is the empty text. Long texts are encoded part by part."""
        data, offsets = utf8(column)
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        bounds = self._bounds(data, offsets)
        parts, counts, at = [], [], 0
        while at < len(bounds) - 1:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + 2 * TEXT_BYTES, "right")) - 1)
            ids, many = self._encode(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
            parts.append(ids)
            counts.append(many)
            at = to
        total = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return np.concatenate(parts), total[np.searchsorted(bounds, offsets, "right") - 1] if len(bounds) != len(offsets) else total

    def _bounds(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """offsets, and places inside long texts: before a space that a visible ASCII character follows, as pieces always part there."""
        sizes = np.diff(offsets)
        if not self.in_pieces or self.added_with_space or not len(sizes) or sizes.max() <= 2 * TEXT_BYTES:
            return offsets
        more = [offsets]
        for row in np.flatnonzero(sizes > 2 * TEXT_BYTES).tolist():
            at, end = int(offsets[row]), int(offsets[row + 1])
            while end - at > 2 * TEXT_BYTES:
                half = at + TEXT_BYTES // 2
                window = data[half : at + TEXT_BYTES + 1]
                good = np.flatnonzero((window[:-1] == 0x20) & (window[1:] > 0x20) & (window[1:] < 0x7F))
                at = half + int(good[-1]) if len(good) else at + TEXT_BYTES
                if len(good):
                    more.append(np.array([at]))
        return np.sort(np.concatenate(more))

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each row has)"""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        text = data.tobytes().decode("utf-8")
        at = offsets - np.searchsorted(np.flatnonzero((data & 0xC0) == 0x80), offsets)  # rows in code points
        if not self.in_pieces:
            parts = self._library([text[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = self.classes[np.minimum(points, PLAIN_BELOW)]
        ids, counts, unlike = self._plain(text, points, at, kind, n)
        odd_at = [np.flatnonzero(kind == 9), unlike]
        for content in self.added:
            place = text.find(content)
            while place >= 0:
                odd_at.append(np.array([place]))
                place = text.find(content, place + 1)
        odd_rows = np.unique(np.searchsorted(at, np.concatenate(odd_at), "right") - 1)
        if not len(odd_rows):
            return ids, counts
        begin = np.concatenate([[0], np.cumsum(counts)])
        odd = dict(zip(odd_rows.tolist(), self._library([text[at[r] : at[r + 1]] for r in odd_rows]), strict=True))
        parts = [odd[r] if r in odd else ids[begin[r] : begin[r + 1]] for r in range(n)]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def _plain(self, text: str, points: np.ndarray, at: np.ndarray, kind: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, how many each row has, where the store's text is another one)."""
        end = len(points)
        new = np.ones(end, bool)
        new[1:] = kind[1:] != kind[:-1]
        new[at[:-1][at[:-1] < end]] = True
        run = np.flatnonzero(new)
        to = np.append(run[1:], end)
        space = kind[run] == 0
        ends_row = np.zeros(end + 1, bool)
        ends_row[at[1:]] = True
        inner = space & ~ends_row[to]
        new[to[inner & (to - run >= 2)] - 1] = True  # the last of several spaces stands with what follows
        new[to[inner & (points[to - 1] == 0x20)]] = False
        start = np.flatnonzero(new)
        stop = np.append(start[1:], end)
        keys = range_hash(points, start, stop, BYTE_BASE)
        order = np.argsort(keys)
        ranked = keys[order]
        head = np.ones(len(keys), bool)
        head[1:] = ranked[1:] != ranked[:-1]
        found, first = ranked[head], order[head]
        which = np.empty(len(keys), np.int64)
        which[order] = np.cumsum(head) - 1
        if self.kept > KEPT_PIECES or self.said_at[self.kept] > KEPT_POINTS:
            self._sweep()
        number = self._find(found)
        fresh = number < 0
        self.again[number[~fresh]] = True
        if fresh.any():
            bounds = zip(start[first[fresh]].tolist(), stop[first[fresh]].tolist(), strict=True)
            number[fresh] = self._add(found[fresh], [text[a:b] for a, b in bounds])
        where, begin = self.said_at[number], self.begin[number]  # the pools hold fewer than 2**31 numbers
        length = (stop - start).astype(np.int32)
        said = np.repeat(where[which] - start.astype(np.int32), length)
        said += np.arange(end, dtype=np.int32)
        np.minimum(said, self.said_at[self.kept] - 1, out=said)
        other = self.said[said] != points
        unlike = np.concatenate([np.flatnonzero(other), start[(self.said_at[number + 1] - where)[which] != length]])
        size = (self.begin[number + 1] - begin)[which]
        total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        spot = np.repeat(begin[which] - total[:-1].astype(np.int32), size)
        spot += np.arange(total[-1], dtype=np.int32)
        return self.pool[spot], np.diff(total[np.searchsorted(start, at)]), unlike


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same rows with end_id after each."""
    n = len(offsets) - 1
    return np.insert(ids, offsets[1:], np.uint32(end_id)), offsets + np.arange(n + 1)


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_texts(texts: Sequence[str | None], path: str) -> list[list[int]]:
    """Ids of a few texts (for tests)."""
    ids, offsets = encoder(path).encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]

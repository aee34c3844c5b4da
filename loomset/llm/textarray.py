"""Words, windows and hashes of whole Arrow text columns, as numpy arrays.

Texts of a batch lie one after another in one byte array. Words and hashes are taken from that
array by a few vector operations, so the cost of a word does not include a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are handled in slices of about so many bytes; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Odd multipliers of the polynomial hashes (modulo 2**64) of bytes and of words.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95

#: Longer tables of powers are not kept, and so many words are hashed at once.
KEPT_POWERS, HASHED_WORDS = 1 << 22, 1 << 17

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null is the empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut between rows into slices of about limit bytes of text."""
    _, offsets = utf8(batch.column(text))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())

        def table(b: int) -> np.ndarray:
            out = np.ones(size, np.uint64)
            done, step = 1, np.uint64(b)
            while done < size:
                out[done : 2 * done] = out[:done] * step
                step = step * step
                done *= 2
            return out

        with np.errstate(over="ignore"):
            have = table(base), table(pow(base, -1, 1 << 64))
        if size <= KEPT_POWERS:
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (one to one)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def range_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """64-bit hashes of values[start:end]; the same values give the same hash at any place."""
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def word_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BYTE_BASE) -> np.ndarray:
    """range_hash of words in the order of the text, some at a time: a long text costs little more than its words."""
    out = np.zeros(len(start), np.uint64)
    for i in range(0, len(start), HASHED_WORDS):
        a, b = start[i : i + HASHED_WORDS], end[i : i + HASHED_WORDS]
        out[i : i + HASHED_WORDS] = range_hash(values[a[0] : b[-1]], a - a[0], b - a[0], base)
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word: a run of bytes other than space and 0x09 to 0x0D."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    word = ~_SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    at = offsets[:-1][offsets[:-1] < n]
    first[at] = word[at]
    at = offsets[1:][offsets[1:] > 0] - 1
    last[at] = word[at]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, "right") - 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def per_row(row: np.ndarray, n: int) -> np.ndarray:
    """Where the words of each row begin: n + 1 places."""
    return np.searchsorted(row, np.arange(n + 1))


def window_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Indexes of the words at which a window of size words of one row starts."""
    count = np.maximum(np.diff(first) - size + 1, 0)
    base = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    return base + np.arange(int(count.sum()))


def rolling_min_place(values: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """For each start the place of the least of values[start:start+size]; of equal ones the first.

    starts are places such that start + size - 1 is inside values. Doubling makes it
    log2(size) vector steps instead of one step for each place.
    """
    place = np.arange(len(values))
    best = values
    span = 1
    while span * 2 <= size:
        other = best[span:]
        less = other < best[:-span]
        place = np.where(less, place[span:], place[:-span])
        best = np.where(less, other, best[:-span])
        span *= 2
    a, b = place[starts], place[starts + size - span]
    return np.where(values[b] < values[a], b, a)

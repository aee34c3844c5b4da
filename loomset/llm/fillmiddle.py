"""Fill-in-the-middle texts: each text is cut at two units and its parts are put in another order behind marks.

A unit is a run of ASCII letters or one other code point. The units of a text are counted once, over its bytes, piece by piece; where every
STEP-th unit begins, its byte and code point are recorded. A cut is found by binary search in these checkpoints, and by a short
rescan from the nearest one before it. So a cut costs STEP units at most however long the text is, and no list of units is held.

Where the cuts fall, and whether and in which of two forms a text is transformed, follows from SHA-256 of the seed and the doc_id alone: reruns and lost
executors change nothing. Forms: `plain` (the text itself), `psm` (prefix, suffix, middle), `spm` (suffix, prefix, middle). A text that is
empty or holds a mark stays plain, so that every output can be taken apart again: restored() rebuilds the text from output and form.

Null texts are empty texts. A null doc_id is hashed as no digits. Rows that repeat a doc_id are cut by the same numbers, each in its own units.
All columns stay, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.llm.textarray import slices, utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1:"
PLAIN_FROM, SPM_BELOW = 90, 20
#: Units between checkpoints, and bytes that are counted at once.
STEP, PIECE = 1_024, 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: Bytes that go on with a code point.
_GOES_ON = np.zeros(256, bool)
_GOES_ON[0x80:0xC0] = True


def _begins(data: np.ndarray, after_letter: bool) -> np.ndarray:
    """Which bytes begin a unit. after_letter: whether the byte before the first one is a letter."""
    letter = _LETTER[data]
    run = np.empty(len(data), bool)
    run[:1], run[1:] = after_letter, letter[:-1]
    return ~(_GOES_ON[data] | letter & run)


class Checkpoints:
    """Counts the units of one text and records where every STEP-th one begins."""

    def __init__(self, data: np.ndarray, step: int = STEP, piece: int = PIECE):
        self.data, self.step = data, step
        at, points, units = [], [], 0
        seen = 0  # code points before the piece
        for low in range(0, len(data), piece):
            part = data[low : low + piece]
            begins = np.flatnonzero(_begins(part, bool(low and _LETTER[data[low - 1]])))
            marked = begins[-units % step :: step]
            lead = np.cumsum(~_GOES_ON[part])  # code points up to and with each byte
            at.append(marked + low)
            points.append(lead[marked] - 1 + seen)
            units += len(begins)
            seen += int(lead[-1])
        self.units, self.points = units, seen
        self.byte = np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int64)
        self.point = np.concatenate([*points, np.zeros(0, np.int64)]).astype(np.int64)

    def cut(self, unit: int) -> tuple[int, int]:
        """(bytes, code points) before a unit; the number of units stands for the end."""
        if unit >= self.units:
            return len(self.data), self.points
        low, high = 0, len(self.byte)
        while high - low > 1:
            half = (low + high) // 2
            low, high = (half, high) if half * self.step <= unit else (low, half)
        byte, point, left = int(self.byte[low]), int(self.point[low]), unit - low * self.step
        while True:
            part = self.data[byte : byte + 2 * self.step]
            begins = np.flatnonzero(_begins(part, bool(byte and _LETTER[self.data[byte - 1]])))
            off = int(begins[left]) if left < len(begins) else len(part)
            byte, point = byte + off, point + int((~_GOES_ON[part[:off]]).sum())
            if left < len(begins):
                return byte, point
            left -= len(begins)


def _numbers(doc_id: Column) -> Column:
    """Four numbers of 32 bits for each document."""
    digest = F.sha2(F.concat(F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)))


def _joined(kind: str, a: bytes, b: bytes, c: bytes) -> bytes:
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    return b"".join((p, a, s, c, m, b) if kind == "psm" else (s, c, p, a, m, b))


def _cut(data: np.ndarray, numbers: list[int]) -> tuple[int, str, int | None, int | None, bytes | None]:
    """(units, form, code points of the prefix, those of the middle, output) of a text; the output of a plain text is not given."""
    points = Checkpoints(data)
    n, (h1, h2, h3, h4) = points.units, numbers
    text = data.tobytes()
    if not text or h3 % 100 >= PLAIN_FROM or any(mark.encode() in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, None
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    (a, before), (b, until) = points.cut(first), points.cut(second)
    kind = "spm" if h4 % 100 < SPM_BELOW else "psm"
    return n, kind, before, until - before, _joined(kind, text[:a], text[a:b], text[b:])


def transform(documents: DataFrame, names: tuple[str, str, str, str, str] = ("n", "form", "prefix_chars", "middle_chars", "output")) -> DataFrame:
    """The documents with n (units), form, prefix_chars and middle_chars (code points, null if plain) and output. None of these columns may be there."""
    if clash := {x.lower() for x in names} & {x.lower() for x in documents.columns}:
        raise ValueError(f"the documents already have {sorted(clash)}")
    text, numbers = "_text", "_numbers"
    while {text, numbers} & {x.lower() for x in documents.columns}:
        text, numbers = "_" + text, "_" + numbers
    rows = documents.withColumns({text: F.coalesce(F.col("text").cast("string"), F.lit("")), numbers: _numbers(F.col("doc_id"))})
    n, form, prefix, middle, output = names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                data, offsets = utf8(part.column(text))
                found = [_cut(data[a:b], h) for a, b, h in zip(offsets[:-1].tolist(), offsets[1:].tolist(), part.column(numbers).to_pylist(), strict=True)]
                made = [data[a:b].tobytes() if x[4] is None else x[4] for x, a, b in zip(found, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                rest = part.drop_columns([text, numbers])
                new = [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.int64()), pa.array([x[3] for x in found], pa.int64()), pa.array(made, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*rest.columns, *new], [*rest.schema.names, n, form, prefix, middle, output])

    schema = documents.schema.add(n, "long").add(form, "string").add(prefix, "long").add(middle, "long").add(output, "string")
    return rows.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form alone."""
    between = lambda begin, end: F.substring(output, begin + 3, end - begin - 3)
    p, s, m = F.instr(output, PREFIX), F.instr(output, SUFFIX), F.instr(output, MIDDLE)
    rest = F.substring(output, m + 3, F.length(output))
    return F.when(form == "psm", F.concat(between(p, s), rest, between(s, m))).when(form == "spm", F.concat(between(p, m), rest, between(s, p))).otherwise(output)


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the sha256 of output and of the restored text."""
    found = transform(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))

"""Column functions that stay inside generated code."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What may be changed by strip_accents.
ACCENTED = "[\u00c0-\u024f\u0300-\u036f\u1e00-\u1eff]"


@lru_cache(1)
def _accents() -> tuple[str, str]:
    """Latin letters that decompose to one letter with marks, and those letters; then the marks, which have no counterpart."""
    pairs = []
    for point in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(point):
            pairs.append((chr(point), base))
    marks = "".join(chr(p) for p in range(0x300, 0x370))
    return "".join(a for a, _ in pairs) + marks, "".join(b for _, b in pairs)


def strip_accents(text: Column) -> Column:
    """Latin letters without their marks; other letters stay."""
    return F.translate(text, *_accents())


def parse_date(text: Column, *formats: str) -> Column:
    """The date that the first fitting format reads (ISO if none is given), or null: nothing is an error."""
    if not formats:
        return F.try_to_timestamp(text).cast("date")
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null if the denominator is 0 or null."""
    return F.try_divide(numerator, denominator)


def unit(vector: Column) -> Column:
    """An array of numbers at length one; one of zeros stays."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / F.greatest(length, F.lit(1e-12)))


def arg_max(values: Column) -> Column:
    """Place (from 0) of the greatest value, the first of equal ones; null for an empty array."""
    return F.when(F.size(values) > 0, F.array_position(values, F.array_max(values)) - 1)


def bucket_count(buckets: Column, value: str) -> Column:
    """doc_count of one key in an array of (key, doc_count); 0 if it is not there."""
    hit = F.filter(buckets, lambda b: b["key"] == value)
    return F.coalesce(F.try_element_at(hit, F.lit(1))["doc_count"], F.lit(0).cast("long"))


def filled(value: Column, default: object) -> Column:
    return F.coalesce(value, F.lit(default))


def finite(value: Column) -> Column:
    """Null for what is no number of JSON: not-a-number and the infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)

"""Exact quantiles of a column by distributed selection: no task sees more values than its own partition has.

A quantile lies between the values of two neighbouring ranks. Each rank is looked for in an open interval of values. In a round one pass of partial
aggregates gives, for every interval, two values that stand close below and above the rank by a mergeable sketch, and a second pass counts exactly how many
values are below, at, between and above them. So the rank is one of the two values, or the interval shrinks to a part of about 1 / ACCURACY of its values.
If the sketch was wrong the rank is in another part, which the counts say: the result never depends on the sketch. An interval of SMALL values at most is
collected and sorted. A trillion values take three rounds.

Null and NaN are left out; a column without any other value has no quantiles (None). The frame is read in each pass: give a table that is written.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY, SMALL = 4_000, 10_000


@dataclass
class _Sought:
    """A rank (from 0), the open interval it is in, how many values are below that, and how many in it."""

    rank: int
    below: int
    inside: int
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def within(self, x: Column) -> Column:
        out = F.lit(True)
        if self.low is not None:
            out &= x > F.lit(self.low)
        if self.high is not None:
            out &= x < F.lit(self.high)
        return out

    def narrow(self, a: float, b: float, counts: Sequence[int]) -> None:
        """counts: values of the interval below a, at a, between, at b (0 if b is a)."""
        place = self.rank - self.below
        under, at_a, between, at_b = counts
        if place < under:
            self.high, self.inside = a, under
        elif place < under + at_a:
            self.value = a
        elif place < under + at_a + between:
            self.low, self.high, self.below, self.inside = a, b, self.below + under + at_a, between
        elif place < under + at_a + between + at_b:
            self.value = b
        else:
            passed = under + at_a + between + at_b
            self.low, self.below, self.inside = b, self.below + passed, self.inside - passed


def _round(rows: DataFrame, x: Column, sought: list[_Sought]) -> None:
    """One step for all ranks that are still open."""
    near = []
    for s in sought:
        share, room = (s.rank - s.below) / max(1, s.inside - 1), 2 / ACCURACY
        near.append(F.percentile_approx(F.when(s.within(x), x), F.array(F.lit(max(0.0, share - room)), F.lit(min(1.0, share + room))), F.lit(ACCURACY)))
    bounds = rows.agg(*(c.alias(f"n{k}") for k, c in enumerate(near))).first()
    count = lambda what: F.count(F.when(what, 1))
    counts = []
    for s, (a, b) in zip(sought, bounds, strict=True):
        inside = s.within(x)
        counts += [count(inside & (x < F.lit(a))), count(inside & (x == F.lit(a))), count(inside & (x > F.lit(a)) & (x < F.lit(b))), count(inside & (x == F.lit(b)) & F.lit(b != a))]
    found = rows.agg(*(c.alias(f"c{k}") for k, c in enumerate(counts))).first()
    for k, (s, (a, b)) in enumerate(zip(sought, bounds, strict=True)):
        s.narrow(a, b, found[4 * k : 4 * k + 4])


def quantiles(frame: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """The interpolated quantile of each share (0 to 1): at the place share * (n - 1) among the sorted values."""
    if wrong := [p for p in shares if not 0 <= p <= 1]:
        raise ValueError(f"shares are from 0 to 1, not {wrong[0]}")
    x = F.col("x")
    rows = frame.select(F.col(column).cast("double").alias("x")).filter(x.isNotNull() & ~F.isnan(x))
    n = rows.count()
    if not n:
        return [None for _ in shares]
    places = [p * (n - 1) for p in shares]
    ranks = sorted({r for place in places for r in (math.floor(place), math.ceil(place))})
    sought = {r: _Sought(r, 0, n) for r in ranks}
    while open_ := [s for s in sought.values() if s.value is None]:
        small = [s for s in open_ if s.inside <= SMALL]
        if small:
            held = rows.agg(*(F.array_sort(F.collect_list(F.when(s.within(x), x))).alias(f"h{k}") for k, s in enumerate(small))).first()  # SMALL values of each at most
            for s, values in zip(small, held, strict=True):
                s.value = values[s.rank - s.below]
        large = [s for s in open_ if s.inside > SMALL]
        if large:
            _round(rows, x, large)
    value = lambda place: sought[math.floor(place)].value + (place - math.floor(place)) * (sought[math.ceil(place)].value - sought[math.floor(place)].value)
    return [value(place) for place in places]

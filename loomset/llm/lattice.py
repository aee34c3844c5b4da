"""The E8 lattice: nearest points, and all points near a place. Rows of arrays are places in 8 dimensions."""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np

#: No place is farther than this from a lattice point.
COVERING_RADIUS = 1.0


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest integer point whose coordinates have an even sum."""
    out = np.rint(x)
    odd = np.flatnonzero(out.sum(1) % 2 != 0)
    if len(odd):
        off = x[odd] - out[odd]
        worst = np.abs(off).argmax(1)
        step = np.where(off[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
        out[odd, worst] += step
    return out


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point: E8 is the even-sum integer points and the same moved by one half in each coordinate."""
    whole = _nearest_even(x)
    half = _nearest_even(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.where(nearer[:, None], whole, half)


@lru_cache(1)
def offsets() -> np.ndarray:
    """The origin and all E8 points of squared norm 2 and 4 (240 and 2160)."""
    pairs = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((-1.0, 1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            pairs.append(v)
    halves = [np.array(s) / 2 for s in itertools.product((-1.0, 1.0), repeat=8) if s.count(-1.0) % 2 == 0]
    roots = np.array(pairs + halves)
    sums = (roots[:, None] + roots[None]).reshape(-1, 8)
    second = np.unique(sums[(sums**2).sum(1) == 4], axis=0)
    return np.concatenate([np.zeros((1, 8)), roots, second])


def near(x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, point) for all lattice points within radius of each row, which is at most 1.44 (so that two shells hold them)."""
    home = decode(x)
    off = x - home
    shells = offsets()
    squared = (off**2).sum(1)[:, None] + (shells**2).sum(1)[None] - 2 * off @ shells.T
    row, which = np.nonzero(squared <= radius * radius)
    return row, home[row] + shells[which]

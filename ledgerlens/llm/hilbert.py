"""The Hilbert curve in any number of dimensions, by entry points and directions of its subcubes.

A state of the curve in a subcube is its entry corner e and its direction d. On each level the bits of a point,
turned into the frame of (e, d), name the subcube on the way by the inverse Gray code, and that subcube's own entry
and direction give the next state.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _gray(x: int) -> int:
    return x ^ (x >> 1)


def _ungray(x: int) -> int:
    out = 0
    while x:
        out ^= x
        x >>= 1
    return out


def _rotate(x: int, by: int, n: int) -> int:
    """To the left by `by` places in n bits."""
    by %= n
    return ((x << by) | (x >> (n - by))) & ((1 << n) - 1)


def _entry(w: int) -> int:
    return _gray(2 * ((w - 1) // 2)) if w else 0


def _direction(w: int, n: int) -> int:
    x = w - 1 + w % 2 if w else 0
    ones = 0
    while x & 1:
        ones += 1
        x >>= 1
    return ones % n


def curve_tables(n: int) -> tuple[list[int], list[int]]:
    """For each state (e * n + d) and each corner of n bits: the digit on the curve, and the next state."""
    digits, following = [], []
    for e in range(1 << n):
        for d in range(n):
            for corner in range(1 << n):
                w = _ungray(_rotate(corner ^ e, n - (d + 1) % n, n))
                digits.append(w)
                following.append((e ^ _rotate(_entry(w), d + 1, n)) * n + (d + _direction(w, n) + 1) % n)
    return digits, following


def hilbert_column(cells: list[Column], bits: int) -> Column:
    """The curve index (long) of a cell whose coordinates are whole numbers below 2**bits; null if one is null."""
    n = len(cells)
    digits, following = (F.array(*[F.lit(x) for x in t]) for t in curve_tables(n))
    point = F.array(*[c.cast("int") for c in cells])

    def step(state, level):
        bit = lambda j: F.call_function("shiftright", point[j], level).bitwiseAND(F.lit(1)) * F.lit(1 << j)
        corner = reduce(Column.__add__, map(bit, range(n)))
        at = state["s"] * F.lit(1 << n) + corner
        return F.struct((state["h"] * F.lit(1 << n) + F.element_at(digits, at + 1)).alias("h"), F.element_at(following, at + 1).alias("s"))

    levels = F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1))
    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("s"))
    return F.when(F.forall(point, lambda x: x.isNotNull()), F.aggregate(levels, start, step, lambda x: x["h"]))


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """The curve indices (uint64; bits * dimensions <= 64) of the rows of an array of whole numbers below 2**bits."""
    rows, n = cells.shape
    mask = (1 << n) - 1
    entries = np.array([_entry(w) for w in range(1 << n)], dtype=np.int64)
    directions = np.array([_direction(w, n) for w in range(1 << n)], dtype=np.int64)
    ungray = np.array([_ungray(w) for w in range(1 << n)], dtype=np.int64)
    out, e, d = np.zeros(rows, dtype=np.uint64), np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64)
    rotate = lambda x, by: ((x << by) | (x >> (n - by))) & mask
    for level in range(bits - 1, -1, -1):
        corner = np.zeros(rows, dtype=np.int64)
        for j in range(n):
            corner |= ((cells[:, j].astype(np.int64) >> level) & 1) << j
        w = ungray[rotate(corner ^ e, (n - (d + 1) % n) % n)]
        out = (out << np.uint64(n)) | w.astype(np.uint64)
        e ^= rotate(entries[w], (d + 1) % n)
        d = (d + directions[w] + 1) % n
    return out

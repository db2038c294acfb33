"""A signature tree over shingle sets, and its dual traversal.

A set's signature is a bitmap of its hashed shingles. Two sets share at most as many shingles as their bitmaps share
bits, and the shingles that one of them loses to bits taken twice. A node holds the union of the bitmaps below it, the
range of their sizes and the most lost in one; a pair of nodes whose bitmaps share too few bits for its smallest sets
has no linked pair below it.
"""

from __future__ import annotations

import numpy as np

FANOUT = 8


def need(a, b):
    """Nine times the least overlap of linked sets of sizes a and b (100 * overlap >= 80 * union)."""
    return 4 * (a + b)


def bitmap(shingles: np.ndarray, bits: int) -> np.ndarray:
    """The signature as 64-bit words; bits is a power of two from 64."""
    out = np.zeros(bits, dtype=np.uint8)
    out[(shingles >> np.uint64(20)).astype(np.int64) & (bits - 1)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def bits_for(n: int) -> int:
    return 1 << min(17, max(8, int(2 * n - 1).bit_length()))


def folded(words: np.ndarray, bits: int) -> np.ndarray:
    """A signature with fewer bits: the halves that fall on each other are united."""
    while len(words) * 64 > bits:
        words = words[: len(words) // 2] | words[len(words) // 2 :]
    return words


def may_link(a: np.ndarray, size_a: int, b: np.ndarray, size_b: int) -> bool:
    """Whether two signatures, of any lengths, allow a link."""
    bits = 64 * min(len(a), len(b))
    a, b = folded(a, bits), folded(b, bits)
    lost = min(size_a - int(np.bitwise_count(a).sum()), size_b - int(np.bitwise_count(b).sum()))
    return 9 * (int(np.bitwise_count(a & b).sum()) + lost) >= need(size_a, size_b)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets, ascending, are linked."""
    if 100 * min(len(a), len(b)) < 80 * max(len(a), len(b)):
        return False
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    return 9 * int((a[at] == b).sum()) >= need(len(a), len(b))


class Groups:
    """Union-find over whole numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


class Tree:
    """Levels from the sets themselves up; each level has words, low, high (sizes) and lost of its nodes.

    words: a row for each set, its signature; all of one length. size: of each set.
    """

    def __init__(self, words: np.ndarray, size: np.ndarray):
        self.order = np.lexsort((words[:, 0], size))
        words, size = words[self.order], size[self.order]
        self.levels = [(words, size, size, size - np.bitwise_count(words).sum(1).astype(np.int64))]
        while len(self.levels[-1][0]) > FANOUT:
            words, low, high, lost = self.levels[-1]
            at = np.arange(0, len(words), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(words, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(lost, at)))

    def pairs(self):
        """Pairs of sets that the bounds allow, as two arrays; few rows of pairs are held at a time."""
        top = len(self.levels) - 1
        n = len(self.levels[top][0])
        stack = [(top, *np.triu_indices(n))]
        while stack:
            level, i, j = stack.pop()
            if len(i) > 4096:
                stack += [(level, i[4096:], j[4096:])]
                i, j = i[:4096], j[:4096]
            words, low, high, lost = self.levels[level]
            near = (100 * high[i] >= 80 * low[j]) & (100 * high[j] >= 80 * low[i])
            i, j = i[near], j[near]
            shared = np.bitwise_count(words[i] & words[j]).sum(1).astype(np.int64) + np.minimum(lost[i], lost[j])
            fits = 9 * shared >= need(low[i], low[j])
            i, j = i[fits], j[fits]
            if not level:
                apart = i != j
                yield self.order[i[apart]], self.order[j[apart]]
            elif len(i):
                below = len(self.levels[level - 1][0])
                grid = np.arange(FANOUT)
                a = (i[:, None, None] * FANOUT + grid[None, :, None]).repeat(FANOUT, 2).ravel()
                b = (j[:, None, None] * FANOUT + grid[None, None, :]).repeat(FANOUT, 1).ravel()
                keep = (a < below) & (b < below) & (a <= b)
                stack.append((level - 1, a[keep], b[keep]))


def trees(marks: list[np.ndarray], size: np.ndarray):
    """Trees that hold all pairs that may link, each with the places of its sets, and which of them it has for the first time.

    Sets of linked sizes have signatures that differ in length by a factor of two at most, so there is a tree for each
    length, with the sets of twice that length folded.
    """
    length = np.array([len(m) for m in marks])
    for n in sorted(set(length.tolist())):
        own, twice = np.flatnonzero(length == n), np.flatnonzero(length == 2 * n)
        at = np.concatenate([own, twice])
        yield Tree(np.stack([folded(marks[k], 64 * n) for k in at]), size[at]), at, np.arange(len(at)) < len(own)


def links(marks: list[np.ndarray], size: np.ndarray, test=None, start: list[int] | None = None, asks: list[bool] | None = None) -> list[tuple[int, int]]:
    """Pairs of sets, out of those that may link and pass the test, that join all that such pairs connect.

    marks, size: signatures and sizes. test(i, j): whether a pair is linked; without one what may link is. A pair that
    is in one group already isn't tested. start: groups known before, a number for each set. asks: pairs without a set
    that asks are known before too.
    """
    groups, found = Groups(len(marks)), []
    first: dict[int, int] = {}
    for k, g in enumerate(start or []):
        groups.join(k, first.setdefault(g, k))
    for tree, at, own in trees(marks, size) if len(marks) > 1 else ():
        for i, j in tree.pairs():
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                a, b = int(at[x]), int(at[y])
                if (own[x] or own[y]) and (asks is None or asks[a] or asks[b]) and groups.find(a) != groups.find(b) and (test is None or test(a, b)):
                    groups.join(a, b)
                    found.append((a, b))
    return found

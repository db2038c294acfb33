"""Words of many texts found at once: where they begin, and a number for each different one.

Texts are UTF-8 bytes, one after another in one array. Characters have classes, continuation bytes that of their
character, so runs of a class are runs of bytes.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE, MARK = range(5)
#: Bytes of the longest word whose key holds it whole; longer ones are kept in a dictionary.
SHORT = 15
#: Zero bytes behind the texts, so that a key can be read anywhere.
PAD = 24
_U = np.uint64
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every character: letters, numbers and marks by general category, White_Space as given."""
    kinds = {"L": LETTER, "N": NUMBER, "M": MARK}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    # White_Space of Unicode. Fixed values.
    out[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return out


def joined(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one padded array, and where each begins (and the last ends)."""
    edges = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(r) for r in raw], out=edges[1:])
    size = int(edges[-1])
    data = np.frombuffer(b"".join([*raw, bytes(PAD + -(size + PAD) % 8)]), dtype=np.uint8)
    return data, edges


def classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    table = _classes()
    out = table[:256][data]  # right for ASCII
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int32)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        at = lambda k: data[np.minimum(lead + k, len(data) - 1)].astype(np.int32) & 0x3F
        code = np.where(size == 2, (first & 0x1F) << 6 | at(1), np.where(size == 3, (first & 0x0F) << 12 | at(1) << 6 | at(2), (first & 0x07) << 18 | at(1) << 12 | at(2) << 6 | at(3)))
        kind = table[np.minimum(code, sys.maxunicode)]
        for k in range(4):
            mine = size > k
            out[lead[mine] + k] = kind[mine]
    return out


class WordTable:
    """A row number for each different word, found for many words at once.

    A word of SHORT bytes at most is its own key (its bytes and its size, in two numbers), so two are never confused.
    """

    def __init__(self, bits: int = 14):
        self.clear(bits)

    def clear(self, bits: int = 14) -> None:
        self.n, self.long, self.long_bytes = 0, {}, 0
        self._empty(bits)

    def _empty(self, bits: int) -> None:
        self.bits = bits
        self.low, self.high = np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits, dtype=np.uint64)
        self.row = np.full(1 << bits, -1, dtype=np.int32)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        x = (low ^ (high * _U(0x9E3779B97F4A7C15))) * _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(32)
        return ((x * _U(0x94D049BB133111EB)) >> _U(64 - self.bits)).astype(np.int64)

    @staticmethod
    def keys(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys of words of SHORT bytes at most; no word is empty, so no key is zero."""
        whole, at = data.view("<u8"), begin >> 3
        shift = ((begin & 7) << 3).astype(np.uint64)
        back = _U(63) - shift
        a, b, c = whole[at], whole[at + 1], whole[at + 2]
        low = (a >> shift) | ((b << back) << _U(1))
        high = (b >> shift) | ((c << back) << _U(1))
        low &= _KEEP[np.minimum(size, 8)]
        high &= _KEEP[np.clip(size - 8, 0, 7)]
        return low, high | (size.astype(np.uint64) << _U(56))

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Rows, -1 where there is none."""
        at = self._slot(low, high)
        out = self.row[at]
        open_ = np.flatnonzero((out >= 0) & ((self.low[at] != low) | (self.high[at] != high)))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.row) - 1)
            here = at[open_]
            out[open_] = self.row[here]
            open_ = open_[(out[open_] >= 0) & ((self.low[here] != low[open_]) | (self.high[here] != high[open_]))]
        return out

    def insert(self, low: np.ndarray, high: np.ndarray, rows: np.ndarray) -> None:
        """Keys that are different and new, with their rows."""
        self._grow(len(rows))
        self.n += len(rows)
        self._place(low, high, rows)

    def _place(self, low: np.ndarray, high: np.ndarray, rows: np.ndarray) -> None:
        at = self._slot(low, high)
        open_ = np.arange(len(rows))
        while len(open_):
            here = at[open_]
            free = open_[self.row[here] < 0]
            self.row[at[free]] = rows[free]  # of those at one slot the last stays
            won = free[self.row[at[free]] == rows[free]]
            self.low[at[won]], self.high[at[won]] = low[won], high[won]
            done = np.zeros(len(rows), dtype=bool)
            done[won] = True
            open_ = open_[~done[open_]]
            at[open_] = (at[open_] + 1) & (len(self.row) - 1)

    def _grow(self, more: int) -> None:
        bits = self.bits
        while 2 * (self.n + more) > 1 << bits:
            bits += 1
        if bits != self.bits:
            used = np.flatnonzero(self.row >= 0)
            low, high, rows = self.low[used], self.high[used], self.row[used]
            self._empty(bits)
            self._place(low, high, rows)

    def rows(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of all words, and which words were new (one of each), in the order of their rows."""
        size = end - begin
        out = np.empty(len(begin), dtype=np.int64)
        short = size <= SHORT
        some = np.flatnonzero(short)
        low, high = self.keys(data, begin[some], size[some])
        found = self.find(low, high)
        new = [some[:0]]
        open_ = np.flatnonzero(found < 0)
        if len(open_):
            order = np.lexsort((high[open_], low[open_]))
            a, b = low[open_][order], high[open_][order]
            first = np.ones(len(order), dtype=bool)
            first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            nth = np.cumsum(first) - 1
            n = int(nth[-1]) + 1
            rows = np.arange(self.n, self.n + n, dtype=np.int32)
            self.insert(a[first], b[first], rows)
            found[open_[order]] = rows[nth]
            new.append(some[open_[order[first]]])
        out[some] = found
        later = []
        for k in np.flatnonzero(~short).tolist():
            word = data[begin[k] : end[k]].tobytes()
            row = self.long.get(word)
            if row is None:
                row = self.long[word] = self.n
                self.n += 1
                self.long_bytes += len(word)
                later.append(k)
            out[k] = row
        return out, np.concatenate([*new, np.array(later, dtype=np.int64)])


def spread(values: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of values that begin at these places and have these sizes, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(begin - (ends - sizes), sizes) + np.arange(total)]

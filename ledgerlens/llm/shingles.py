"""Hashed word shingles of many texts at once.

Texts are lower-cased (A to Z only) and split into words at space and the ASCII control spaces. A shingle is five
words in a row; a text of one to four words has one shingle of all of them; one without words has none. Words and
shingles are 64-bit hashes; equal ones count as the same.
"""

from __future__ import annotations

import numpy as np

LENGTH = 5
_BASE = 0x9E3779B97F4A7C15  # odd
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1B54A32D192ED03))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PLACE = mix(np.arange(1, 6, dtype=np.uint64) * _U(0x8CB92BA72F3D8DD7)) | _U(1)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and how many each text has."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw).translate(_LOWER) + b"\n", dtype=np.uint8)
    inside = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    begin, end = edges[::2], edges[1::2]
    up, down = _grown(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_LETTER[data] * up[: len(data)], out=sums[1:])
    words = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    stops = np.cumsum([len(r) + 1 for r in raw])
    return words, np.diff(np.searchsorted(begin, stops), prepend=0)


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts, ascending in each, and how many each text has."""
    words, counts = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    n = len(words)
    made = np.zeros(max(0, n - LENGTH + 1), dtype=np.uint64)
    for k in range(LENGTH):
        made += words[k : k + len(made)] * _PLACE[k]
    whole = owner[: len(made)] == owner[LENGTH - 1 :] if len(made) else np.zeros(0, dtype=bool)
    hashes, owners = [mix(made[whole])], [owner[: len(made)][whole]]
    first = np.cumsum(counts) - counts
    for size in range(1, LENGTH):
        short = np.flatnonzero(counts == size)
        total = np.full(len(short), size, dtype=np.uint64)
        for k in range(size):
            total += words[first[short] + k] * _PLACE[k]
        hashes.append(mix(total))
        owners.append(short)
    hashes, owners = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    return hashes[new], np.bincount(owners[new], minlength=len(texts))

"""Digests: SHA-256 is built in; Keccak-256 runs on Arrow batches, a permutation for all rows at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LANES, ROUNDS, RATE = 25, 24, 136


def sha256(value: Column) -> Column:
    return F.unhex(F.sha2(value.cast("binary"), 256))


def _round_constants() -> list[int]:
    """By the linear feedback shift register of the Keccak specification: bits 2**j - 1 of each round's constant."""
    out, state = [], 1
    for _ in range(ROUNDS):
        constant = 0
        for j in range(7):
            if state & 1:
                constant |= 1 << ((1 << j) - 1)
            state = (state << 1) ^ (0x171 if state & 0x80 else 0)
        out.append(constant)
    return out


def _offsets() -> list[int]:
    """How far each lane (x + 5 y) turns: triangular numbers along the walk (x, y) -> (y, 2 x + 3 y)."""
    out, x, y = [0] * LANES, 1, 0
    for t in range(24):
        out[x + 5 * y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return out


CONSTANTS, OFFSETS = _round_constants(), _offsets()


def _turn(lane: np.ndarray, by: int) -> np.ndarray:
    return lane if not by else (lane << np.uint64(by)) | (lane >> np.uint64(64 - by))


def permute(lanes: list[np.ndarray]) -> list[np.ndarray]:
    """Keccak-f[1600] over arrays of lanes, one element for each message."""
    for constant in CONSTANTS:
        column = [lanes[x] ^ lanes[x + 5] ^ lanes[x + 10] ^ lanes[x + 15] ^ lanes[x + 20] for x in range(5)]
        mixed = [column[(x + 4) % 5] ^ _turn(column[(x + 1) % 5], 1) for x in range(5)]
        lanes = [lanes[k] ^ mixed[k % 5] for k in range(LANES)]
        moved: list = [None] * LANES
        for x in range(5):
            for y in range(5):
                moved[y + 5 * ((2 * x + 3 * y) % 5)] = _turn(lanes[x + 5 * y], OFFSETS[x + 5 * y])
        lanes = [moved[k] ^ (~moved[(k + 1) % 5 + 5 * (k // 5)] & moved[(k + 2) % 5 + 5 * (k // 5)]) for k in range(LANES)]
        lanes[0] = lanes[0] ^ np.uint64(constant)
    return lanes


def keccak_many(messages: list[bytes]) -> list[bytes]:
    """Keccak-256 of messages of any lengths; those with equally many blocks go together."""
    out: list[bytes] = [b""] * len(messages)
    blocks = np.array([len(m) // RATE + 1 for m in messages], dtype=np.int64)
    for count in np.unique(blocks):
        at = np.flatnonzero(blocks == count)
        padded = np.zeros((len(at), int(count) * RATE), dtype=np.uint8)
        for row, k in enumerate(at):
            m = messages[k]
            padded[row, : len(m)] = np.frombuffer(m, dtype=np.uint8)
            padded[row, len(m)] ^= 0x01
            padded[row, -1] ^= 0x80
        words = padded.view("<u8").reshape(len(at), int(count), RATE // 8)
        lanes = [np.zeros(len(at), dtype=np.uint64) for _ in range(LANES)]
        for b in range(int(count)):
            lanes = permute([lane ^ words[:, b, k] if k < RATE // 8 else lane for k, lane in enumerate(lanes)])
        digest = np.stack(lanes[:4], axis=1).astype("<u8")
        for row, k in enumerate(at):
            out[k] = digest[row].tobytes()
    return out


@F.pandas_udf(T.BinaryType())
def keccak256(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Keccak-256 of binary values; null stays null."""
    for series in values:
        there = [bytes(v) for v in series if v is not None]
        found = iter(keccak_many(there))
        yield pd.Series([None if v is None else next(found) for v in series], dtype=object)


@F.pandas_udf(T.StringType())
def checksum_address(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """20 bytes as mixed-case hex: a letter is upper case where the digit of the Keccak-256 of the lower-case hex is 8 or
    more. Null for other lengths."""
    for series in values:
        plain = [bytes(v).hex() if v is not None and len(v) == 20 else None for v in series]
        masks = iter(keccak_many([p.encode() for p in plain if p is not None]))
        yield pd.Series([None if p is None else "0x" + "".join(c.upper() if m >= "8" else c for c, m in zip(p, next(masks).hex(), strict=False)) for p in plain], dtype=object)

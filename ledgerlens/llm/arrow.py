"""Steps shared by operators that work on Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters of text handled at once; rows with texts in an Arrow batch, unless the session has another number than Spark's own.
SLICE, ROWS = 1 << 20, 500
_SETTING, _DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def map_texts(rows: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow over rows with texts, in batches of a bounded number of rows: ten thousand long texts are too much for a task.

    Memory that a Python worker has freed goes back to the system after each task, since workers live on.
    """
    spark = rows.sparkSession
    if spark.conf.get(_SETTING) == _DEFAULT:
        spark.conf.set(_SETTING, str(ROWS))

    def trimmed(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return rows.mapInArrow(trimmed, schema)


def trim() -> None:
    pa.default_memory_pool().release_unused()  # Arrow's own, which the C library doesn't know
    with suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batches in parts of bounded text (`most` characters and the rest of a text), with the column as strings; a null is an empty string."""
    for batch in batches:
        at, size = 0, 0
        texts: list[str] = []
        for value in batch.column(column):
            text = value.as_py() or ""
            texts.append(text)
            size += len(text) + 16
            if size >= most:
                yield batch.slice(at, len(texts)), texts
                at, size, texts = at + len(texts), 0, []
        if texts:
            yield batch.slice(at, len(texts)), texts


def runs(batches, keys: list[str]):
    """The rows of sorted batches as tables, one for each run of equal keys."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not len(table):
            continue
        change = np.zeros(len(table) - 1, dtype=bool)
        for k in keys:
            v = table.column(k).to_numpy()
            change |= v[1:] != v[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(table)]
        if held and any(held[0].column(k)[0] != table.column(k)[0] for k in keys):
            yield pa.concat_tables(held)
            held = []
        for a, b in zip(edges, edges[1:], strict=False):
            held.append(table.slice(a, b - a))
            if b < len(table):
                yield pa.concat_tables(held)
                held = []
    if held:
        yield pa.concat_tables(held)


_made: dict = {}


def once(key, make, kept: int = 6):
    """What make() gives, made once in a Python worker for each key; the one that was asked for longest ago goes first."""
    _made[key] = _made.pop(key) if key in _made else make()
    while len(_made) > kept:
        del _made[next(iter(_made))]
    return _made[key]

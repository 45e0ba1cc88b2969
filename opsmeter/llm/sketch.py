"""Tables of fixed size, counters or bits, filled by all tasks and put together in two levels."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TASKS = 32


def packed(table: np.ndarray) -> bytes:
    """The table as bytes; most entries are small or zero, so they compress well."""
    return zlib.compress(table.tobytes(), 1)


def combined(parts: DataFrame, empty: np.ndarray, combine: np.ufunc) -> np.ndarray:
    """All rows of ``parts (table)``, packed tables like ``empty``, combined by a numpy function.

    Each of ``TASKS`` tasks takes in its rows one by one, and one task their results: no
    task holds more than two tables, and one reaches the driver.
    """
    size, kind = len(empty), empty.dtype

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(size, kind), False
        for batch in batches:
            for value in batch.column(0):
                combine(total, np.frombuffer(zlib.decompress(value.as_buffer()), kind), out=total)
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([packed(total)], pa.binary())], ["table"])

    level = parts.repartition(TASKS).mapInArrow(add, "table binary")
    row = level.repartition(1).mapInArrow(add, "table binary").first()
    return np.frombuffer(zlib.decompress(row["table"]), kind) if row else empty

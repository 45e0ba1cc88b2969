"""Helpers of the operators: stored intermediates, text columns, word hashes."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Bounds of the Arrow batches that Python functions get: texts vary in length by five
# orders of magnitude, so rows alone bound nothing.
BATCH_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def configure(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes for the frames planned from here on.

    Python workers also learn where this package lies, should it not be installed.
    """
    for name, value in BATCH_SETTINGS.items():
        spark.conf.set(name, value)
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*paths, root])


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; the warehouse where that is unset."""
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/llm-stage"


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed by ``scratch`` or when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid4()}"
    made = _made.get()
    if made is not None:
        made.append(path)
    handle = spark._jvm.org.apache.hadoop.fs.Path(path)
    handle.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(handle)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Remove a stored table that no frame reads any more."""
    handle = spark._jvm.org.apache.hadoop.fs.Path(path)
    handle.getFileSystem(spark._jsc.hadoopConfiguration()).delete(handle, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """Remove what is stored inside the block at its end, but for the frames named to ``keep``.

        with scratch(spark) as keep:
            ...
            keep(stored(result, "result"))

    No frame that goes on may read another one: they end with the block. Inside another
    block, what is kept is the outer block's to keep or remove.
    """
    made: list[str] = []
    kept: set[str] = set()
    token = _made.set(made)
    try:
        yield lambda *frames: kept.update(frame.stored_at for frame in frames)
    finally:
        _made.reset(token)
        outer = _made.get()
        for path in made:
            if path not in kept:
                remove(spark, path)
            elif outer is not None:
                outer.append(path)


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, sizes are known.

    Executors may be lost afterwards; the copy stays. ``zstd`` keeps it small.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path  # for ``scratch``
    return out


def utf8(text: str = "text") -> str:
    """SQL: the text, empty for null."""
    return f"coalesce(cast(`{text}` AS STRING), '')"


def remainder(doc_id: str, parts: int) -> str:
    """SQL: crc32 of the id written as text, modulo ``parts``; a null id counts as empty text."""
    return f"pmod(crc32(cast(coalesce(cast(`{doc_id}` AS STRING), '') AS BINARY)), {parts})"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


# --- words of whole texts as 64-bit hashes, without a Python loop over words ---

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTERS = mix(np.arange(256, dtype=np.uint64), 77) | np.uint64(1)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(20, n.bit_length())
        base, inverse = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 2**64), np.uint64)
        base[0] = inverse[0] = 1
        _powers[:] = [np.multiply.accumulate(base), np.multiply.accumulate(inverse)]
    return _powers[0], _powers[1]


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array, null as empty, and the texts' offsets in them."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces_of(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer text is a range of its own."""
    _, offsets = text_buffer(texts)
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(len(texts), max(stop, start + 1))
        yield start, stop
        start = stop


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered, and each text's range in them.

    A polynomial over random letter values modulo 2^64, scrambled; equal words get equal
    hashes wherever they stand. Words never span texts.
    """
    raw, offsets = text_buffer(texts)
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    blank = _BLANK[raw]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, blank[:-1]
    starts = np.flatnonzero(~blank & (before | first[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, blank[1:]
    ends = np.flatnonzero(~blank & (after | first[1:])) + 1
    # a text's end ends a word even when the next text is empty
    powers, inverses = _tables(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTERS[_LOWER[raw]] * powers[:n], out=total[1:])
    words = mix((total[ends] - total[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))
    return words, np.searchsorted(starts, offsets)


def sequence_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` words, by the place of the first word."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(length):
        out = mix(out + words[i : i + n], i + 1)
    return out


def sorted_distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values

"""What the operators share: tables, blocks of text as numpy arrays, word bounds and hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 18  # text held as numpy arrays at a time; it only sizes the work
BATCH_ROWS = 1000  # rows that travel to a Python worker at a time: these hold whole texts
BASE = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2**64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` as long and ``text``; whatever else the table holds, under any name, is left.

    A row without a doc_id can be neither named nor ordered and takes no part. Rows that share a
    doc_id are one document given several times.
    """
    small_batches(docs.sparkSession)
    return docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )


def small_batches(spark: SparkSession) -> None:
    """The usual ten thousand texts to a batch fill an executor's memory on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def release() -> None:
    """Give unused memory back at the end of a task; the worker waits for others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library is glibc
    if trim:
        trim(0)


def buckets(spark: SparkSession, each: int = 3) -> int:
    """Groups to deal packed rows into: some for every shuffle partition, so that they even out."""
    return each * int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column laid end to end, and where each value begins (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string()
    column = pc.fill_null(column.cast(kind), b"" if pa.types.is_binary(column.type) else "")
    count = len(column)
    if not count:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + count + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(
    batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES, lower: bool = False
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, bytes and bounds of consecutive documents, about ``limit`` bytes at a time."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        texts = pc.utf8_lower(batch.column(1)) if lower else batch.column(1)
        data, bounds = utf8(texts)
        low = 0
        while low < len(ids):
            high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + limit, "right")) - 1)
            part = bounds[low : high + 1]
            yield ids[low:high], data[part[0] : part[-1]], part - part[0]
            low = high
        del ids, data, bounds, batch
    release()


def mix(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of splitmix64)."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_powers: dict[str, np.ndarray] = {}


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < count:
        size = max(count, BLOCK_BYTES + 1)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[name] = np.cumprod(row)
    return _powers["up"][:count], _powers["down"][:count]


class Rolling:
    """Hash of any stretch of a sequence of 64-bit symbols, by differences of prefix sums."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=self.prefix[1:])

    def every(self, length: int) -> np.ndarray:
        """Of the stretches of this length, one for each start."""
        count = max(0, len(self.prefix) - length)
        return mix((self.prefix[length:] - self.prefix[:count]) * self.down[:count])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        length = (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mix((self.prefix[ends] - self.prefix[starts]) * self.down[starts] + length)


#: Bytes of words: all but space and 0x09-0x0D.
GRAPHIC = np.ones(256, bool)
GRAPHIC[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words without punctuation: ASCII letters and digits, and all beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _lower[data]


def word_bounds(
    data: np.ndarray, bounds: np.ndarray, part: np.ndarray = GRAPHIC
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of bytes that are ``part`` of words, and the number of words
    before each document. A word never crosses documents."""
    inside = part[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cut = bounds[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begins[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, bounds)


def word_values(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Rolling(BYTE_VALUES[data]).of(starts, ends)


def listed(column: pa.ChunkedArray) -> np.ndarray:
    """The values of a column of lists, end to end."""
    values = column.combine_chunks().flatten()
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.to_numpy(zero_copy_only=False)


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(offsets, pa.array(values))


def dealt(bucket: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """One row per bucket with its values as lists, in their order."""
    order = np.argsort(bucket, kind="stable")
    keys, sizes = np.unique(bucket, return_counts=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(keys.astype(np.int32)), *(lists(v[order], sizes) for v in columns.values())],
        names=["bucket", *columns],
    )


def run_bounds(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values (of all columns) begin and end."""
    count = len(columns[0])
    if not count:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.zeros(count, bool)
    new[0] = True
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
    heads = np.flatnonzero(new)
    return heads, np.r_[heads[1:], count]

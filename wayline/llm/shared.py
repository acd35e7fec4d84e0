"""Helpers of the text operators: scratch tables in the shared folder, and words as numpy arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of the six characters between words.
GAP = r"[\x20\x09-\x0D]+"
LOCAL_SCRATCH = "/tmp/checkpoints"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, one of our own, but in local mode only."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{LOCAL_SCRATCH}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/wayline/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, batch_bytes: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and survives lost executors.

    The shuffle files of the step are deleted when it ends, for nothing reads them again. With `batch_bytes`, no more goes
    to a Python worker at once (one row at least), for steps on wide rows.
    """
    spark = df.sparkSession
    wanted = {CLEANUP: "true"} | ({BATCH: str(batch_bytes)} if batch_bytes else {})
    path, before = scratch_path(spark, name), {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that stage() wrote, once nothing reads them any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for f in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str = "text"):
    """Array of the words of a column; null gives an empty array."""
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), GAP), lambda w: w != "")


# ---------------------------------------------------------------- words as arrays, for operators in Python

_IS_GAP = np.zeros(256, bool)
_IS_GAP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def small_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `limit` bytes of text at most (one row at least)."""
    at = None
    for b in batches:
        at = b.schema.get_field_index(column) if at is None else at
        sizes = pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < len(sizes):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield b.slice(start, stop - start)
            start = stop


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows on end, and each row's start (one more than rows). Nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    n, wide = len(col), pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each row the index of its first word (one more than rows)."""
    inside = ~_IS_GAP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a word ends with its row
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    if len(last):
        last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words as one Arrow array of bytes."""
    if not len(starts):
        return pa.array([], pa.binary())
    body = data[~_IS_GAP[data]]  # words are all that is no gap
    ends_at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends_at), pa.py_buffer(body)])


def word_codes(col: pa.Array, lower: bool = False) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(code of each word, the distinct words that codes stand for, first word of each row)."""
    data, offsets = text_bytes(col)
    if lower:
        data = _LOWER[data]
    starts, ends, rows = word_spans(data, offsets)
    coded = word_array(data, starts, ends).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist(), rows


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x

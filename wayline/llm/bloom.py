"""A blocked Bloom filter: the bits of one key lie in one block of 512, so a probe touches one cache line.

Its size is bounded, so it may be sent to every executor; more keys than it is made for give more false positives, never a miss.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mix64

BLOCK_WORDS = 8
PROBES = 8
BITS_PER_KEY = 12
MAX_FILTER_BYTES = 64 << 20


def _bits(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Word of the filter and bit in it of each key and probe."""
    h = mix64(h.view(np.uint64))
    block = ((h >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)
    second = mix64(h ^ np.uint64(0x9E3779B97F4A7C15))
    at = np.stack([(second >> np.uint64(7 * k)) & np.uint64(511) for k in range(PROBES)])
    return block * BLOCK_WORDS + (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))


def bloom_words(keys: DataFrame, key: str, max_filter_bytes: int = MAX_FILTER_BYTES) -> np.ndarray:
    """The filter of a column's values. Executors turn keys to words; the driver holds max_filter_bytes at most."""
    blocks = max(1, min(max_filter_bytes // 64, -(-keys.count() * BITS_PER_KEY // 512)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word, bit = _bits(b.column(0).to_numpy(zero_copy_only=False), blocks)
            yield pa.RecordBatch.from_arrays([pa.array(word.ravel()), pa.array(bit.ravel().view(np.int64))], names=["word", "bits"])

    words = keys.select(F.xxhash64(key)).mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(blocks * BLOCK_WORDS, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def possible(df: DataFrame, key: str, words: np.ndarray, inside: bool = True) -> DataFrame:
    """The rows of df whose key may be in the filter; with inside=False the others, whose key is not in it."""
    sent = df.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        for b in batches:
            word, bit = _bits(b.column(b.num_columns - 1).to_numpy(zero_copy_only=False), len(words) // BLOCK_WORDS)
            yield b.filter(pa.array(((words[word] & bit) != 0).all(axis=0) == inside))

    keyed = df.withColumn("__bloom", F.xxhash64(key))
    return keyed.mapInArrow(run, keyed.schema).drop("__bloom")

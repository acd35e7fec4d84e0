"""Removal of passages that repeat across documents, by overlapping chunks of lines.

Lines are hashed; a rolling hash runs over each two neighbour lines with words, and whatever blank lines stand between them:
they are a chunk. A line of `LONG_LINE` words or more is a passage of itself and a chunk of its own too. Chunks overlap and
depend on their own lines only, so a repeated run of several lines is covered whole by repeated chunks, whatever surrounds it;
a short single line is no chunk, however often it occurs.

Of chunks with equal bytes, the first by (doc_id, text hash, place) stays and the lines of the others go. Each removed line
stands in a kept copy earlier in that order, and the earliest copy of any line is never removed.

Only chunks whose 64-bit hash occurs twice are compared, and only their bytes are shuffled for it. Groups of equal
chunks are reduced to their first by a partial aggregate. The repeated hashes and the first chunks are written before all
chunks are joined with them: the join is then one of two plain tables, whose hot keys the adaptive skew join splits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import bloom_words, possible
from .shared import discard, small_batches, stage

LONG_LINE = 25
_MIX, _MASK = 0x9E3779B97F4A7C15, 2**64 - 1
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def chunks_of(text: str) -> list[tuple[int, int, int]]:
    """(first line, end line, hash) of each chunk of a text."""
    out, before, long_before, rolled = [], -1, False, 0
    for k, line in enumerate(text.split("\n")):
        h = xxhash.xxh3_64_intdigest(line)
        rolled = (rolled * _MIX + h) & _MASK
        if not _WORD.search(line):
            continue
        long = len(line) >= 2 * LONG_LINE - 1 and len(_WORD.findall(line)) >= LONG_LINE
        if long:
            out.append((k, k + 1, h))
        if before >= 0 and not (long and long_before):
            out.append((before, k + 1, rolled))
        before, long_before, rolled = k, long, h
    return out


def _chunk_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, thash, idx, hash) of every chunk."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            at, idx, hashes = [], [], []
            for row, text in enumerate(b.column(2).to_pylist()):
                for k, (_, _, h) in enumerate(chunks_of(text)):
                    at.append(row)
                    idx.append(k)
                    hashes.append(h - 2**63)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(idx, pa.int32()), pa.array(hashes, pa.int64())], names=["doc_id", "thash", "idx", "hash"])

    return docs.mapInArrow(run, f"doc_id {kind}, thash long, idx int, hash long")


def _candidates(docs: DataFrame) -> DataFrame:
    """Bytes and lines of the chunks named in `wanted`."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([("doc_id", docs.limit(0).toArrow().schema.field("doc_id").type), ("thash", pa.int64()), ("idx", pa.int32()), ("hash", pa.int64()), ("chunk", pa.string()), ("first", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text", 2 << 20):
            rows = []
            for doc, thash, text, wanted in zip(*(c.to_pylist() for c in b.columns)):
                lines, chunks = text.split("\n"), chunks_of(text)
                for w in wanted:
                    k = w["idx"]
                    a, z, _ = chunks[k]
                    rows.append({"doc_id": doc, "thash": thash, "idx": k, "hash": w["hash"], "chunk": "\n".join(lines[a:z]), "first": a, "end": z})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return docs.mapInArrow(run, f"doc_id {kind}, thash long, idx int, hash long, chunk string, first int, end int")


def _key(thash: str) -> Column:
    return F.xxhash64("doc_id", thash)


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, thash, cuts): ranges [first, end) of the lines to remove, for texts that lose any."""
    d = docs.select("doc_id", F.xxhash64("text").alias("thash"), "text").where(F.col("text").isNotNull())
    rows = stage(_chunk_rows(d), "chunks")
    twice = stage(rows.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "twice")
    named = rows.join(twice, "hash", "left_semi").dropDuplicates(["doc_id", "thash", "idx"])
    lists = stage(named.groupBy("doc_id", "thash").agg(F.collect_list(F.struct("idx", "hash")).alias("wanted")), "wanted")
    discard(rows, twice)
    # Only texts that may hold such a chunk are shuffled.
    once = possible(d.withColumn("__k", _key("thash")), "__k", bloom_words(lists.select(_key("thash").alias("__k")), "__k"))
    once = once.join(lists.withColumnsRenamed({"doc_id": "__d", "thash": "__t"}), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("thash") == F.col("__t"))).select("doc_id", "thash", "text", "wanted")
    cand = stage(_candidates(once).dropDuplicates(["doc_id", "thash", "idx"]), "candidates")
    place = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "thash", "idx")
    kept = stage(cand.groupBy("hash", "chunk").agg(F.min(place).alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n"), "kept")
    gone = cand.join(kept, ["hash", "chunk"]).where(~(F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("thash") == F.col("kept.thash")) & (F.col("idx") == F.col("kept.idx"))))
    cuts = stage(gone.groupBy("doc_id", "thash").agg(F.sort_array(F.collect_set(F.struct("first", "end"))).alias("cuts")), "cuts")
    discard(lists, cand, kept)
    return cuts


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with text without its repeated passages, n_lines (before), n_removed (lines) and text_before.

    Null texts stay null with 0 lines; empty texts have one line without words. Equal rows (doc_id and text) count as
    one document and each gets its result; rows with a null doc_id come first in the order. Other columns are kept, those
    named like new ones are replaced.
    """
    found = removed_lines(docs)
    d = docs.withColumn("__h", F.xxhash64("text")).withColumn("__k", _key("__h"))
    words = bloom_words(found.select(_key("thash").alias("__k")), "__k")
    cuts = found.select(F.col("doc_id").alias("__d"), F.col("thash").alias("__t"), F.col("cuts").alias("__cuts"))
    touched = possible(d, "__k", words).join(cuts, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__h") == F.col("__t")), "left").drop("__d", "__t")
    # Texts that lose nothing stay where they are.
    d = touched.unionByName(possible(d, "__k", words, inside=False).withColumn("__cuts", F.lit(None).cast(found.schema["cuts"].dataType)))
    lines = F.split(F.col("text"), "\n")
    cut = F.flatten(F.transform("__cuts", lambda c: F.sequence(c["first"], c["end"] - 1)))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), cut), lambda k: F.get(lines, k))
    d = d.withColumn("__left", F.when(F.col("__cuts").isNotNull(), left))
    d = d.withColumns({
        "text_before": F.col("text"),
        "n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"),
        "n_removed": F.when(F.col("__left").isNotNull(), F.size(lines) - F.size("__left")).otherwise(0).cast("long"),
        "text": F.when(F.col("__left").isNotNull(), F.array_join("__left", "\n")).otherwise(F.col("text")),
    })
    return d.drop("__h", "__k", "__cuts", "__left")

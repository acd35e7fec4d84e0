"""A training-text pipeline: quality, repeated passages, near duplicates, benchmark leaks, mixing.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of `documents`; the last one
gives a row per emitted copy. run() writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import decontaminate, jaccard_join, line_dedup, mixing, quality_rules
from wayline.llm.shared import stage, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the certified cutoffs keep."""
    return quality_rules.judge(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one holds; those that keep no word of theirs go."""
    d = line_dedup.dedup_lines(docs.select(*COLUMNS)).where(F.coalesce(F.col("n_removed") == 0, F.lit(True)) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return d.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (0.8 of 5-word shingles in common); rows without an id stay."""
    docs = docs.select(*COLUMNS)
    groups = jaccard_join.near_duplicates(docs, percent=80, size=5)
    gone = stage(groups.groupBy("doc_id").agg(F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("own")).where("own = 0").select("doc_id"), "copies")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no item of the benchmark."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per emitted copy of a document, numbered from 1."""
    mixed = mixing.mix(docs.select(*COLUMNS), keep=("text", "lang", "n_chars")).where("copies > 0")
    return mixed.select(*COLUMNS, "size", "source_size", "target", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("mix", mix)]

#: Certified cutoffs, content-defined chunks and near-duplicate components are not expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs

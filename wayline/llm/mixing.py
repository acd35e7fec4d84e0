"""Mixing sources to target weights by systematic sampling.

Within a source, documents stand in a fixed order on a line, each as long as its expected copies; one random
offset is added, and a document is emitted once per whole number that its stretch crosses. Documents of like size
stand together, so that the words taken come near the target, whichever offset is drawn.

The prefix sums are exact integers (units of 1e-12 copies) in two levels: the documents of one size class in `BUCKETS` buckets by
a hash of their id, then documents within a bucket. The order is always the same, however many documents there are. A hot
source is many buckets, so no task gets all of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage, words_of

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
UNIT = 10**12
BUCKETS = 1024


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, size): sources by code point, null last, weigh `weights` in turn.

    Water filling: sources whose cap (max_copies x size) is low for their weight are filled to the cap, the others
    share the rest by weight. The table of sources is small; only it is sorted as a whole.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    every = Window.partitionBy(F.lit(1))
    rank = F.row_number().over(every.orderBy(F.col("source").isNull(), F.hex("source"))) - 1
    d = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long"))
    d = d.withColumn("cap", F.col("source_size") * max_copies)
    order = every.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.hex("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    d = d.withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    d = d.withColumn("level", F.col("left") / F.col("open"))
    # The first source that its cap doesn't bind sets the level for all from there on.
    free = F.col("weight") * F.col("level") <= F.col("cap")
    d = d.withColumn("level", F.first(F.when(free, F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.coalesce(F.col("weight") * F.col("level"), F.col("cap").cast("double"))
    return d.select("source", "source_size", "source_docs", target.alias("target"))


def _draw(key: Column) -> Column:
    """32 bits of MD5, the same in every engine."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def size_class(size: Column) -> Column:
    """Eight classes for each doubling of size + 1: the place of its highest bit and the next three."""
    n = size.cast("long") + 1
    high = F.length(F.bin(n)) - 1
    return (high * 8 + F.call_function("shiftright", n * 8, high).bitwiseAND(F.lit(7))).cast("int")


def systematic_copies(docs: DataFrame, expected: str = "expected", group: str = "source", size: str = "size", doc_id: str = "doc_id", tie: str | None = None, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """Add copies (long): how often each row is emitted. `expected` (double, not negative) is rounded to 1e-12.

    The order is (size class, bucket, size, doc_id, tie); the bucket is drawn from doc_id, from `tie` (a string) where that is
    null. Which of several rows comes first is open only between rows that are equal in all of these. Null groups are a
    group. Empty input gives no rows. Sums are decimals: no number of rows overflows them.
    """
    d = docs.withColumn("__e", F.coalesce(F.round(F.col(expected) * UNIT).cast("long"), F.lit(0)))
    d = d.withColumn("__class", size_class(F.col(size)))
    key = F.coalesce(F.col(doc_id).cast("string"), F.col(tie) if tie else F.lit(""), F.lit(""))
    d = d.withColumn("__bucket", F.pmod(_draw(F.concat(F.lit(f"{seed}:"), key)), F.lit(buckets)))
    # One key without nulls for the join and the window, so that rows are dealt out once.
    d = d.withColumn("__group", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("null")))
    exact, place = F.col("__e").cast("decimal(20,0)"), ["__group", "__class", "__bucket"]
    per = d.groupBy(*place).agg(F.sum(exact).alias("__sum"))
    run = Window.partitionBy("__group").orderBy("__class", "__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.floor(_draw(F.concat(F.lit(f"{seed}/"), F.col("__group"))) * (UNIT / 2**32)).cast("long")
    per = per.select(*place, ((F.coalesce(F.sum("__sum").over(run), F.lit(0)) + offset) % UNIT).cast("long").alias("__from"))
    # Written first: a small table of known size is sent to the rows, and a large one is dealt like the window below.
    d = d.join(stage(per, "buckets"), place, "left")
    within = Window.partitionBy(*place).orderBy(size, doc_id, *([tie] if tie else [])).rowsBetween(Window.unboundedPreceding, 0)
    # Whole copies before the bucket, and before the row within it, don't matter: what is left fits in a long.
    d = d.withColumn("__start", ((F.sum(exact).over(within) - exact + F.col("__from")) % UNIT).cast("long"))
    copies = F.expr(f"(__start + __e) div {UNIT}L")
    return d.withColumn("copies", copies).drop("__e", "__group", "__class", "__bucket", "__from", "__start")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = 7, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, and the columns in `keep`, of every row of docs.

    Null and empty texts have size 0 and are never taken more than once per expected copy; null is a source.
    """
    tie = F.when(F.col("doc_id").isNull(), F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("__tie")
    sizes = docs.select("doc_id", "source", F.size(words_of()).cast("long").alias("size"), tie, *keep)
    if not keep:
        sizes = stage(sizes, "sizes")
    targets = stage(source_targets(sizes.select("source", "size"), weights, max_copies), "targets").withColumnRenamed("source", "__s")
    d = sizes.join(targets, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s", "source_docs")
    d = d.withColumn("expected", F.coalesce(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")), F.lit(0.0)))
    d = systematic_copies(d, tie="__tie", seed=seed).drop("__tie")
    return d.withColumn("taken", F.col("copies") * F.col("size"))

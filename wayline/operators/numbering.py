"""Numbers and running totals over a whole table in one order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rounds import written


def running(df: DataFrame, order: list[str], totals: dict[str, str | None]) -> DataFrame:
    """df with running totals in an order that has no ties: name -> column to add up to and with each row, or None to number rows from 0.

    Rows are dealt to tasks by ranges of the order and written; each range adds up its own rows, and what the ranges before it hold, a
    row per range, is joined on.
    """
    d = written(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    value = {n: F.lit(1).cast("long") if c is None else F.col(c) for n, c in totals.items()}
    each = d.groupBy("__range").agg(*[F.sum(v).alias(f"__{n}") for n, v in value.items()])
    before = Window.partitionBy(F.lit(1)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    each = each.select("__range", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in totals])
    own = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(each, "__range")
    return d.select(*df.columns, *[((F.row_number().over(own) - 1).cast("long") if c is None else F.sum(value[n]).over(own)).__add__(F.col(f"__{n}")).alias(n) for n, c in totals.items()])


def numbered(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """df with numbers from 0 on, without gaps, in an order that has no ties."""
    return running(df, order, {name: None})


def quantile(df: DataFrame, column: str, share: float, idx: str = "idx") -> DataFrame:
    """One row with the quantile of a column by which numbered() has numbered df, between two values in proportion: no task holds its values."""
    place = df.agg(F.count("*").alias("__n")).select(((F.col("__n") - 1) * F.lit(share)).alias("__at"))
    near = df.crossJoin(place).where(F.col(idx).isin(F.floor("__at"), F.ceil("__at")))
    return near.agg((F.min(column) + (F.max(column) - F.min(column)) * (F.first("__at") - F.floor(F.first("__at")))).alias(column))

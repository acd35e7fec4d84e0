"""Queries by name, each with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import signals
from .deferred import make

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame. SQL that begins with a comma or select gets the signal view before it."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = signals.SQL + sql if sql.lstrip().startswith((",", "select")) else sql
        return f

    return add


def rounded(c: Column, places: int = 6) -> Column:
    return F.round(c, places) + F.lit(0.0)


def per_row(name: str, columns: dict[str, tuple[Column, str]], places: int | None = 6, more: str = "") -> None:
    """Register a query of expressions over the signal view, keyed by trip and row: name -> (column, SQL)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = signals.signals(spark, sf_dir)
        return d.select("trip_key", "i", *[(make(c) if places is None else rounded(make(c), places)).alias(k) for k, (c, _) in columns.items()])

    picked = ", ".join(f"{s if places is None else f'round({s}, {places}) + 0.0::double'} as {k}" for k, (_, s) in columns.items())
    query(name, f"{more}select trip_key, i, {picked} from sig")(run)

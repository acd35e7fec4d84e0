"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stage

#: A node with more than one in so many edges is met by a broadcast.
SHARE = 1000
#: Up to so many edges, those of any one node are little work for a task.
FEW = 1_000_000


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """(u, v, m): edges (u, v) with the m of their u in `least` (u, m, n), n being the number of its edges.

    Nodes with more than one in `SHARE` of all `total` edges, of which there are at most `SHARE`, are broadcast with their m,
    so their edges stay where they are; only the edges of other nodes are shuffled.
    """
    most = total // SHARE
    hot = F.broadcast(least.where(F.col("n") > most).select("u", "m"))
    rest = edges.join(hot.select("u"), "u", "left_anti").join(least.where(F.col("n") <= most).select("u", "m"), "u")
    return edges.join(hot, "u").select("u", "v", "m").union(rest.select("u", "v", "m"))


def _met(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """with_least(), but of few edges a plain join, which sends no broadcasts through the driver."""
    return with_least(edges, least, total) if total > FEW else edges.join(least.hint("merge").select("u", "m"), "u").select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), longs: root is the smallest node reachable.

    Each step is a partial minimum per node and a join on it, in which edges of nodes with very many are not shuffled (of FEW edges, all are).
    Each step's edges are written to the shared folder. The number of steps grows with the logarithm of the longest path.
    """
    e = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = _mark(e)
    while before[0]:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = _met(both, least, 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _met(down, least, 2 * before[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct()
        last, e = e, stage(small, "edges")
        discard(last)
        now = _mark(e)
        if now == before:
            break
        before = now
    roots = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))

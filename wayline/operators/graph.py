"""Road graph: candidate search by grid cells, snapping, nearest node, crop, routes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import wrap_rad
from .numbering import numbered
from .rounds import discard, written

CELL_M = 120.0
GATE = math.radians(50.0)


def _cells(lo: str, hi: str, cell: float):
    return F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))


#: Rows of either side that meet under one key of a join by cells.
CELL_ROWS = 4096


def join_cells(points: DataFrame, things: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """points and things (with `id`) in the same cell (cx, cy). A cell with more than `limit` rows of a side is split by counts: that side is dealt
    to parts, and the other side's rows go to each of them, so a key holds `limit` of either side and a dense place is work for many tasks."""
    limit = limit or CELL_ROWS
    parts = lambda d, n: d.groupBy("cx", "cy").agg(F.ceil(F.count("*") / limit).alias(n)).where(F.col(n) > 1)
    dense = parts(things, "__a").join(parts(points, "__b"), ["cx", "cy"], "full").select("cx", "cy", F.coalesce("__a", F.lit(1).cast("long")).alias("__a"), F.coalesce("__b", F.lit(1).cast("long")).alias("__b"))
    one = lambda c: F.coalesce(c, F.lit(1).cast("long"))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), one(c) - 1))
    p = points.join(dense, ["cx", "cy"], "left").withColumn("__s", every("__a")).withColumn("__p", F.pmod(F.xxhash64(key), one("__b"))).drop("__a", "__b")
    t = things.join(dense, ["cx", "cy"], "left").withColumn("__p", every("__b")).withColumn("__s", F.pmod(F.xxhash64("id"), one("__a"))).drop("__a", "__b")
    return p.join(t, ["cx", "cy", "__s", "__p"]).drop("__s", "__p")


def segment_candidates(points: DataFrame, segments: DataFrame, reach: float = CELL_M) -> DataFrame:
    """Pairs of points (point_id, e, n, ...) and segments (id, ax, ay, bx, by, bearing) whose boxes are within `reach`.

    Segments are listed in every grid cell that their widened box touches, so the join is on the point's cell; dense cells are split.
    """
    s = segments.withColumns({"x0": F.least("ax", "bx") - reach, "x1": F.greatest("ax", "bx") + reach, "y0": F.least("ay", "by") - reach, "y1": F.greatest("ay", "by") + reach})
    s = s.withColumn("cx", F.explode(_cells("x0", "x1", reach))).withColumn("cy", F.explode(_cells("y0", "y1", reach)))
    p = points.withColumns({"cx": F.floor(F.col("e") / reach), "cy": F.floor(F.col("n") / reach)})
    return join_cells(p, s, "point_id").where("e between x0 and x1 and n between y0 and y1").drop("cx", "cy", "x0", "x1", "y0", "y1")


def snap(points: DataFrame, segments: DataFrame, reach: float = CELL_M, limit: float = 40.0, gate: float = GATE) -> DataFrame:
    """points (point_id, e, n, heading rad) with snap_e, snap_n, bearing, distance, snapped: the nearest segment whose
    direction fits within the gate either way, if it lies within `limit`; unsnapped points stay."""
    c = segment_candidates(points, segments, reach)
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    len2 = dx * dx + dy * dy
    c = c.where(len2 >= 1e-6)
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("e") - F.col("ax")) * dx + (F.col("n") - F.col("ay")) * dy) / F.when(len2 >= 1e-6, len2)))
    turn = F.least(F.abs(wrap_rad(F.col("heading") - F.col("bearing"))), F.abs(wrap_rad(F.col("heading") - F.col("bearing") + math.pi)))
    c = c.where(turn <= gate).withColumns({"snap_e": F.col("ax") + u * dx, "snap_n": F.col("ay") + u * dy})
    c = c.withColumn("distance", F.sqrt((F.col("e") - F.col("snap_e")) ** 2 + (F.col("n") - F.col("snap_n")) ** 2))
    best = c.groupBy("point_id").agg(F.min(F.struct("distance", "id", "snap_e", "snap_n", "bearing")).alias("b"))
    near = F.col("b.distance") <= limit
    d = points.join(best, "point_id", "left").withColumn("snapped", F.coalesce(near, F.lit(False)))
    return d.select("point_id", "e", "n", F.when(F.col("snapped"), F.col("b.snap_e")).otherwise(F.col("e")).alias("snap_e"), F.when(F.col("snapped"), F.col("b.snap_n")).otherwise(F.col("n")).alias("snap_n"), F.col("b.bearing").alias("bearing"), F.col("b.distance").alias("distance"), "snapped")


def nearest_node(points: DataFrame, nodes: DataFrame, cell: float = 500.0) -> DataFrame:
    """(point_id, node, distance): the nearest node, the smaller id first among equals.

    A point looks into its grid cell and the eight around it, and takes what is found within one cell's length; points left over look
    again with cells four times as wide. The nodes of a cell's neighbourhood are listed once (in lists of at most CELL_ROWS), and a
    point takes the least of a list in its own row, so pairs of points and nodes are neither sorted nor shuffled. An empty graph gives no rows.
    """
    extent = nodes.agg(F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("m")).first().m
    if extent is None:
        return points.select("point_id", F.lit(None).cast("long").alias("node"), F.lit(0.0).alias("distance")).limit(0)
    reach = points.agg(F.max(F.greatest(F.abs("e"), F.abs("n"))).alias("m")).first().m or 0.0
    left, found, around = points.select("point_id", "e", "n"), None, F.sequence(F.lit(-1), F.lit(1))
    while True:
        grid = nodes.select("id", "x", "y").withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
        grid = grid.withColumns({"cx": F.floor(F.col("x") / cell) + F.col("dx"), "cy": F.floor(F.col("y") / cell) + F.col("dy")})
        lists = grid.groupBy("cx", "cy").agg(F.ceil(F.count("*") / CELL_ROWS).alias("k"))
        lists = grid.join(lists, ["cx", "cy"]).groupBy("cx", "cy", F.pmod(F.xxhash64("id"), "k").alias("id")).agg(F.collect_list(F.struct("x", "y", "id")).alias("near"))
        p = left.withColumns({"cx": F.floor(F.col("e") / cell), "cy": F.floor(F.col("n") / cell)})
        far = lambda s: F.sqrt((F.col("e") - s["x"]) ** 2 + (F.col("n") - s["y"]) ** 2)
        d = join_cells(p, lists, "point_id").select("point_id", F.array_min(F.transform("near", lambda s: F.struct(far(s).alias("distance"), s["id"].alias("id")))).alias("b"))
        best = d.where(F.col("b.distance") <= cell).groupBy("point_id").agg(F.min("b").alias("b")).select("point_id", F.col("b.id").alias("node"), F.col("b.distance").alias("distance"))
        best = written(best, "nearest")
        found = best if found is None else found.union(best)
        left = left.join(best.select("point_id"), "point_id", "left_anti")
        if cell > 3 * (extent + reach) or left.isEmpty():
            return found
        cell *= 4


def neighbours(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    return frontier.join(edges, frontier["id"] == edges["src"])


def crop(nodes: DataFrame, edges: DataFrame, radius_m: float) -> tuple[DataFrame, DataFrame]:
    """Nodes within a radius of the origin, numbered from 0, and the edges with both ends among them."""
    near = nodes.where(F.col("x") * F.col("x") + F.col("y") * F.col("y") <= radius_m * radius_m)
    near = numbered(near, ["id"])
    a, b = near.select(F.col("id").alias("src"), F.col("idx").alias("a")), near.select(F.col("id").alias("dst"), F.col("idx").alias("b"))
    return near, edges.join(a, "src").join(b, "dst").select("src", "dst", "a", "b", "cost")


def routes(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(query, node, cost, prev): the cheapest way from each query's start to every node it reaches, by the node before it (of
    equal ways found in one round, the least); null at the start itself.

    Rounds of relaxation until nothing becomes cheaper (costs are not negative): only nodes that did go on. Each round is
    checkpointed, which cuts the plan. starts: (query, node).
    """
    roads = edges.select(F.col("src").alias("__src"), F.col("dst").alias("__dst"), F.col("cost").alias("__cost"))
    best = starts.select("query", "node", F.lit(0.0).alias("cost"), F.lit(None).cast(edges.schema["src"].dataType).alias("prev"))
    front = best
    while True:
        step = front.join(roads, F.col("node") == F.col("__src")).select("query", F.col("__dst").alias("node"), (F.col("cost") + F.col("__cost")).alias("cost"), F.col("__src").alias("prev"))
        step = step.groupBy("query", "node").agg(F.min(F.struct("cost", "prev")).alias("s")).select("query", "node", "s.cost", "s.prev")
        old = best.select("query", "node", F.col("cost").alias("old"))
        front = step.join(old, ["query", "node"], "left").where("old is null or cost < old - 1e-9").drop("old").checkpoint()
        if front.isEmpty():
            return best
        best = front.union(best.join(front.select("query", "node"), ["query", "node"], "left_anti")).checkpoint()


#: One node in so many has its whole path made before the others'.
EVERY = 128
#: Of the nodes of a level, one in so many is of the next level too.
LEAP = 16
#: Nodes, and points of the stretch that they share, of a tile.
TILE = 2048
#: A task pairs so many nodes and points of its tiles at once.
RUN, FEW = 256, 16
#: Rows of way_points() that a task makes, about; a tile is not divided.
TASK_ROWS = 1 << 23


def _picked(c, every: int):
    return F.pmod(F.xxhash64(c), F.lit(every)) == 0


def _behind(d: DataFrame, ends) -> DataFrame:
    """Rows (query, node, before, path, ...) whose stretch is put behind that of the row where it begins, until `ends` holds for the
    node before each: stretches double each round."""
    d = written(d, "stretches")
    while not d.where(~ends("before")).isEmpty():
        upper = d.select("query", F.col("node").alias("before"), F.col("before").alias("__b"), F.col("path").alias("__p"))
        more = d.where(~ends("before")).join(upper, ["query", "before"], "left")
        more = more.withColumns({"before": F.col("__b"), "path": F.concat(F.coalesce("__p", F.array().cast(d.schema["path"].dataType)), "path")})
        old, d = d, written(d.where(ends("before")).unionByName(more.select(*d.columns)), "stretches")
        discard(old)
    return d


def with_paths(found: DataFrame) -> DataFrame:
    """(query, node, cost, path) of routes(); path holds the nodes of the way.

    Whole paths of all nodes are as long as the square of the graph's width, so only those of one node in EVERY, picked by a hash, pass between
    rounds. Other nodes have the stretch behind the last such node, and the path up to there is put before it as the last step.
    """
    d = found.select("query", "node", "cost", F.col("prev").alias("before"), F.array("node").alias("path"))
    d = _behind(d, lambda c: F.col(c).isNull() | _picked(c, EVERY))
    whole = _behind(d.where(_picked("node", EVERY)), lambda c: F.col(c).isNull())
    upper = whole.select("query", F.col("node").alias("before"), F.col("path").alias("__p"))
    rest = d.where(~_picked("node", EVERY)).join(upper, ["query", "before"], "left").withColumn("path", F.concat(F.coalesce("__p", F.array().cast(d.schema["path"].dataType)), "path"))
    return whole.select("query", "node", "cost", "path").unionByName(rest.select("query", "node", "cost", "path"))


def _levels(found: DataFrame, item: Column) -> list[DataFrame]:
    """Tables (query, node, before, path): the first of all nodes, each other of one in LEAP of those of the table before. path is the stretch of a
    node's way behind `before`, the last node on it that is of the next table, or the whole way (before is null)."""
    levels = []
    d = found.select("query", "node", F.col("prev").alias("before"), F.array(item).alias("path"))
    while True:
        every = LEAP ** (len(levels) + 1)
        levels.append(_behind(d, lambda c: F.col(c).isNull() | _picked(c, every)))  # noqa: B023
        if levels[-1].where("before is not null").isEmpty():
            return levels
        d = levels[-1].where(_picked("node", every))


def _begins(levels: list[DataFrame]) -> list[DataFrame]:
    """Tables (query, node, before, begin, n) of _levels(): where on its way a node's stretch begins, and its length."""
    found = []
    for d in reversed(levels):
        n = d.select("query", "node", "before", F.size("path").cast("long").alias("n"))
        if found:
            ends = found[-1].select("query", F.col("node").alias("before"), (F.col("begin") + F.col("n")).alias("begin"))
            n = n.join(ends, ["query", "before"], "left")
        else:
            n = n.withColumn("begin", F.lit(None).cast("long"))
        found.append(written(n.select("query", "node", "before", F.coalesce("begin", F.lit(0).cast("long")).alias("begin"), "n"), "begins"))
    return found[::-1]


def _cut(c: str, n: int):
    """A list as lists of n."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / n).cast("int")), lambda k: F.slice(c, k * n + 1, n))


def way_points(found: DataFrame, item: Column) -> DataFrame:
    """(query, node, step, item) of routes(): a row for each node on the way to each node, `item` of it (made of the columns of found), numbered from the start.

    These rows are as many as the square of the graph's length, but no whole way is made before them. Nodes are of levels, and a way is a stretch of
    each level, which it shares with the other nodes under that stretch. A tile is up to TILE such nodes and up to TILE points of the stretch; a task
    gets both lists and pairs them. Rows come point by point for RUN nodes, so that they take little room when they are written.
    """
    levels = _levels(found, item)
    begins, key = _begins(levels), ["level", "query", "top"]
    rows = begins[0].agg(F.sum(F.col("begin") + F.col("n"))).first()[0] or 0

    def stretches(k: int) -> DataFrame:
        d = levels[k].join(begins[k].select("query", "node", "begin"), ["query", "node"])
        d = d.select(F.lit(k).alias("level"), "query", F.col("node").alias("top"), "begin", F.posexplode(_cut("path", TILE)).alias("p", "points"))
        return d.withColumn("begin", F.col("begin") + F.col("p") * TILE).drop("p")

    # A node has its own stretch of the first level to itself. Of each other level it has that of the node before the last one's.
    tiles = stretches(0).select(*key, F.lit(0).cast("long").alias("chunk"), F.array("top").alias("nodes"), "begin", "points")
    top, nodes, shared = begins[0].select("query", "node", F.col("node").alias("top")), None, None
    for k in range(1, len(levels)):
        top = top.join(begins[k - 1].select("query", F.col("node").alias("top"), "before"), ["query", "top"]).where("before is not null")
        top = written(top.select("query", "node", F.col("before").alias("top")), "tops")
        own = top.withColumn("level", F.lit(k))
        nodes, shared = (own, stretches(k)) if nodes is None else (nodes.unionByName(own), shared.unionByName(stretches(k)))
    if nodes is not None:
        many = nodes.groupBy(*key).agg(F.ceil(F.count("*") / TILE).alias("chunks")).where("chunks > 1")
        chunk = F.pmod(F.xxhash64("node"), F.coalesce("chunks", F.lit(1).cast("long")))
        nodes = nodes.join(many, key, "left").groupBy(*key, chunk.alias("chunk")).agg(F.collect_list("node").alias("nodes"))
        tiles = tiles.unionByName(nodes.join(shared, key))
    tiles = tiles.repartition(max(1, math.ceil(rows / TASK_ROWS)), *key, "chunk", "begin")
    d = tiles.select(*key, "chunk", F.posexplode(_cut("nodes", RUN)).alias("run", "nodes"), "begin", "points")
    d = d.select(*key, "chunk", "run", "nodes", "begin", F.posexplode(_cut("points", FEW)).alias("p", "points")).withColumn("begin", F.col("begin") + F.col("p") * FEW)
    # Generators of one stage hold all rows that a row of its input gives; the sort begins another stage, with short lists as its input.
    d = d.sortWithinPartitions(*key, "chunk", "run", "begin")
    d = d.select("query", "nodes", "begin", F.posexplode("points").alias("k", "item")).withColumn("step", F.col("begin") + F.col("k"))
    return d.select("query", F.explode("nodes").alias("node"), "step", "item")

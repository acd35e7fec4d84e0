"""Stored road graphs: tables of nodes, edges, segments and the origin, as Parquet in one folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S


#: Side of a tile of stored segments.
TILE_M = 4096.0


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own, but in local mode only."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file:///tmp/checkpoints"


def write_graph(nodes: DataFrame, edges: DataFrame, segments: DataFrame, lat0: float, lon0: float, folder: str) -> None:
    """Segments are stored by tiles of their first ends, so that a read of a box leaves the files of other tiles alone."""
    nodes.write.parquet(f"{folder}/nodes")
    edges.write.parquet(f"{folder}/edges")
    tiled = segments.withColumns({"tx": F.floor(F.col("ax") / TILE_M).cast("int"), "ty": F.floor(F.col("ay") / TILE_M).cast("int")})
    tiled.repartition("tx", "ty", F.pmod(F.xxhash64("id"), F.lit(4))).write.partitionBy("tx", "ty").parquet(f"{folder}/segments")
    longest = segments.agg(F.max(F.greatest(F.abs(F.col("ax") - F.col("bx")), F.abs(F.col("ay") - F.col("by"))))).first()[0]
    nodes.sparkSession.createDataFrame([("lat0", lat0), ("lon0", lon0), ("longest", float(longest or 0.0))], "key string, value double").write.parquet(f"{folder}/meta")


def origin(spark: SparkSession, folder: str) -> tuple[float, float]:
    """Latitude and longitude of the stored origin: two values."""
    found = {r.key: r.value for r in spark.read.parquet(f"{folder}/meta").where("key in ('lat0', 'lon0')").collect()}
    return found["lat0"], found["lon0"]


def _about(spark: SparkSession, folder: str, lat0: float, lon0: float):
    old = [F.lit(x) for x in origin(spark, folder)]
    return lambda e, n: S.recentre(F.col(e), F.col(n), *old, F.lit(lat0), F.lit(lon0))


def read_segments(spark: SparkSession, folder: str, lat0: float, lon0: float, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Segments for matching, in metres about (lat0, lon0). box: least and greatest x, then y, in the stored graph's own metres; segments that
    reach into it are read, and tiles that none can begin in are not."""
    about = _about(spark, folder, lat0, lon0)
    (ax, ay), (bx, by) = about("ax", "ay"), about("bx", "by")
    d = spark.read.parquet(f"{folder}/segments")
    if box:
        x0, x1, y0, y1 = box
        far = spark.read.parquet(f"{folder}/meta").where("key = 'longest'").first().value
        tile = lambda v: int(v // TILE_M)
        d = d.where(F.col("tx").between(tile(x0 - far), tile(x1 + far)) & F.col("ty").between(tile(y0 - far), tile(y1 + far)))
        d = d.where((F.least("ax", "bx") <= x1) & (F.greatest("ax", "bx") >= x0) & (F.least("ay", "by") <= y1) & (F.greatest("ay", "by") >= y0))
    return d.drop("tx", "ty").withColumns({"ax": ax, "ay": ay, "bx": bx, "by": by})


@dataclass
class Router:
    nodes: DataFrame
    edges: DataFrame
    count: int


def read_router(spark: SparkSession, folder: str, lat0: float, lon0: float) -> Router:
    """Nodes about (lat0, lon0), edges, and how many nodes there are."""
    x, y = _about(spark, folder, lat0, lon0)("x", "y")
    nodes = spark.read.parquet(f"{folder}/nodes")
    return Router(nodes.withColumns({"x": x, "y": y}), spark.read.parquet(f"{folder}/edges"), nodes.count())

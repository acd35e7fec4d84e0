"""GNSS validity and simulated outages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series as W
from .alignment import as_of_forward


def native_validity(rows: DataFrame, stale_s: float = 12.0, moving: float = 3.0) -> DataFrame:
    """Add native_valid: in range, not (0, 0), and not unchanged for longer than stale_s while moving."""
    w = W.over()
    d = rows.withColumn("__new", F.coalesce((F.col("lat") != F.lag("lat").over(w)) | (F.col("lon") != F.lag("lon").over(w)), F.lit(True)))
    d = d.withColumn("__since", F.col("t") - W.forward_fill(F.when(F.col("__new"), F.col("t"))))
    ok = F.coalesce(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & ~((F.col("lat") == 0) & (F.col("lon") == 0)), F.lit(False))
    stale = F.coalesce((F.col("__since") > stale_s) & (F.col("speed") > moving), F.lit(False))
    return d.withColumn("native_valid", ok & ~stale).drop("__new", "__since")


@dataclass(frozen=True)
class Spec:
    """How outages are placed: duration (or length) of each, and the rules for its place."""

    duration_s: float | None = 60.0
    length_m: float | None = None
    warmup_s: float = 20.0
    cooldown_s: float = 10.0
    min_gap_s: float = 60.0
    max_windows: int = 1
    min_speed: float = 3.0
    lead_s: float = 20.0
    moving: float = 0.5
    min_moving: float = 0.6
    max_step_s: float = 0.5

    @property
    def step(self) -> float:
        return min(self.min_gap_s, max(5.0, self.min_gap_s / 4)) if self.max_windows > 1 else 5.0


# The scenarios by name.
SCENARIOS = {
    "isro_60s": Spec(60.0),
    "isro_1km": Spec(None, 1000.0),
    "short_30s": Spec(30.0),
    "tunnels": Spec(30.0, min_gap_s=90.0, max_windows=8),
    "every_2min": Spec(60.0, min_gap_s=120.0, max_windows=50),
}


def with_running(rows: DataFrame, max_step_s: float, moving: float, min_speed: float) -> DataFrame:
    """Prefix counts that make any interval's statistics two lookups: gaps, moving rows, valid rows."""
    w = W.over()
    dt = F.col("t") - F.lag("t").over(w)
    return rows.withColumns({
        "__gaps": W.cum(F.coalesce(dt > max_step_s, F.lit(False)).cast("long")),
        "__moving": W.cum(F.coalesce(F.col("speed") > moving, F.lit(False)).cast("long")),
        "__fast": W.cum(F.coalesce(F.col("speed") >= min_speed, F.lit(False)).cast("long")),
        "__valid": W.cum(F.col("speed").isNotNull().cast("long")),
    })


def fixed_outages(rows: DataFrame, warmup_s: float = 30.0, duration_s: float = 30.0, period_s: float = 120.0, min_speed: float = 3.0, min_moving: float = 0.5, max_gap_s: float = 0.6, recurring: bool = False) -> DataFrame:
    """(trip_key, window, i0, i1, t0, t1): outages at fixed starts, without gaps and mostly moving."""
    d = with_running(rows, max_gap_s, min_speed, min_speed)
    ends = d.groupBy("trip_key").agg(F.max("t").alias("__end"), F.count("*").cast("int").alias("__n"))
    last = F.when(F.col("__end") - duration_s - 5 > warmup_s, F.ceil((F.col("__end") - duration_s - 5 - warmup_s) / period_s).cast("int") - 1).otherwise(0)
    starts = ends.select("trip_key", "__n", F.explode(F.sequence(F.lit(0), F.greatest(last, F.lit(0)) if recurring else F.lit(0))).alias("window"))
    starts = starts.withColumn("s", F.lit(warmup_s) + F.col("window") * period_s)
    spans = as_of_forward(d, starts, "s", "t").withColumnRenamed("found", "i0").withColumn("s1", F.col("s") + duration_s)
    spans = as_of_forward(d, spans, "s1", "t").withColumnRenamed("found", "i1")
    spans = spans.withColumn("i1", F.coalesce("i1", "__n")).where("i0 < __n - 2 and i1 > i0 + 1")
    own = F.coalesce(F.col("speed") > min_speed, F.lit(False)).cast("long")
    a = d.select("trip_key", F.col("i").alias("i0"), F.col("t").alias("t0"), F.col("__gaps").alias("g0"), (F.col("__moving") - own).alias("m0"))
    b = d.select("trip_key", (F.col("i") + 1).alias("i1"), F.col("t").alias("t1"), F.col("__gaps").alias("g1"), F.col("__moving").alias("m1"))
    out = spans.join(a, ["trip_key", "i0"]).join(b, ["trip_key", "i1"])
    fine = (F.col("g1") == F.col("g0")) & ((F.col("m1") - F.col("m0")) / (F.col("i1") - F.col("i0")) >= min_moving)
    return out.where(fine).select("trip_key", "window", "i0", "i1", "t0", "t1")


def candidates(rows: DataFrame, spec: Spec) -> DataFrame:
    """(trip_key, c, i0, i1, t0, t1, span_m, ok) of every candidate start, in order of c."""
    w = W.over()
    d = with_running(rows.withColumn("dist", W.cum(F.coalesce(W.step_m(F.col("lat"), F.col("lon")), F.lit(0.0)))), spec.max_step_s, spec.moving, spec.min_speed)
    d = d.withColumn("__t_last", F.max("t").over(Window.partitionBy("trip_key")))
    ends = d.groupBy("trip_key").agg(F.max("t").alias("__end"), F.max("i").alias("__n"))
    stop = F.greatest(F.lit(spec.warmup_s + spec.step), F.col("__end") - spec.cooldown_s)
    steps = F.ceil((stop - spec.warmup_s) / spec.step).cast("int")
    at = ends.select("trip_key", F.explode(F.sequence(F.lit(0), F.greatest(steps - 1, F.lit(0)))).alias("c")).withColumn("s", F.lit(spec.warmup_s) + F.col("c") * spec.step)
    place = as_of_forward(d, at, "s", "t").withColumnRenamed("found", "i0").where("i0 is not null")
    cols = ["t", "dist", "speed", "__gaps", "__moving", "__fast", "__valid"]
    start = d.select("trip_key", F.col("i").alias("i0"), *[F.col(x).alias(f"{x}_0") for x in cols])
    place = place.join(start, ["trip_key", "i0"])
    if spec.length_m is None:
        to = place.withColumn("__to", F.col("t_0") + spec.duration_s)
        found = as_of_forward(d, to.select("trip_key", "c", "__to"), "__to", "t").withColumnRenamed("found", "i1")
    else:
        to = place.withColumn("__to", F.col("dist_0") + spec.length_m)
        found = as_of_forward(d, to.select("trip_key", "c", "__to"), "__to", "dist").withColumnRenamed("found", "i1")
    lead = as_of_forward(d, place.select("trip_key", "c", (F.col("t_0") - spec.lead_s).alias("__lead")), "__lead", "t").withColumnRenamed("found", "il")
    end = d.select("trip_key", F.col("i").alias("i1"), *[F.col(x).alias(f"{x}_1") for x in cols])
    begin = d.select("trip_key", F.col("i").alias("il"), *[F.col(x).alias(f"{x}_l") for x in cols])
    # Counts up to and including the row before an index: the running count of it less its own row.
    before = d.select("trip_key", F.col("i").alias("ip"), *[F.col(x).alias(f"{x}_p") for x in cols])
    out = place.join(found.select("trip_key", "c", "i1"), ["trip_key", "c"]).where("i1 is not null and i1 > i0").join(lead.select("trip_key", "c", "il"), ["trip_key", "c"]).join(end, ["trip_key", "i1"]).join(begin, ["trip_key", "il"])
    out = out.withColumn("ip", F.col("i1") - 1).join(before, ["trip_key", "ip"])
    lead_rows = F.col("i0") - F.col("il")
    own = lambda x, k: F.when(F.coalesce(x, F.lit(False)), 1).otherwise(0)
    lead_moving = F.col("__moving_0") - own(F.col("speed_0") > spec.moving, 0) - F.col("__moving_l") + own(F.col("speed_l") > spec.moving, 0)
    lead_valid = F.col("__valid_0") - own(F.col("speed_0").isNotNull(), 0) - F.col("__valid_l") + own(F.col("speed_l").isNotNull(), 0)
    inside = F.col("__moving_p") - F.col("__moving_0") + own(F.col("speed_0") > spec.moving, 0)
    span = F.col("dist_p") - F.col("dist_0")
    full = (F.col("t_p") - F.col("t_0") >= spec.duration_s / 2) if spec.length_m is None else (span >= spec.length_m / 2)
    ok = (F.col("speed_0") >= spec.min_speed) & (lead_rows >= 5) & (lead_moving > 0.8 * lead_rows) & (lead_valid > 0.9 * lead_rows)
    ok = ok & (F.col("__gaps_p") == F.col("__gaps_l")) & (inside >= spec.min_moving * (F.col("i1") - F.col("i0"))) & full
    return out.select("trip_key", "c", "i0", "i1", F.col("t_0").alias("t0"), F.col("t_p").alias("t1"), span.alias("span_m"), F.coalesce(ok, F.lit(False)).alias("ok"))


def greedy(found: DataFrame, spec: Spec) -> DataFrame:
    """Accept candidates in order, each min_gap_s after the last accepted one's end, max_windows at most: a fold over each
    trip's sorted candidates."""
    per = found.where("ok").groupBy("trip_key").agg(F.array_sort(F.collect_list(F.struct("c", "i0", "i1", "t0", "t1", "span_m"))).alias("cs"))
    kind = "array<struct<c:int,i0:int,i1:int,t0:double,t1:double,span_m:double>>"
    zero = F.struct(F.lit(-1e18).alias("last"), F.array().cast(kind).alias("got"))

    def take(acc, x):
        fits = (x["t0"] >= acc["last"] + spec.min_gap_s) & (F.size(acc["got"]) < spec.max_windows)
        return F.struct(F.when(fits, x["t1"]).otherwise(acc["last"]).alias("last"), F.when(fits, F.concat(acc["got"], F.array(x).cast(kind))).otherwise(acc["got"]).alias("got"))

    out = per.select("trip_key", F.posexplode(F.aggregate("cs", zero, take)["got"]).alias("window", "x"))
    return out.select("trip_key", "window", "x.i0", "x.i1", "x.t0", "x.t1", (F.col("x.t1") - F.col("x.t0")).alias("span_s"), "x.span_m")


def outages(rows: DataFrame, spec: Spec) -> DataFrame:
    return greedy(candidates(rows, spec), spec)


def apply_mask(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Add gnss_available: 0 in an outage, else the native validity as 0 or 1."""
    hit = windows.where("i1 > i0").select("trip_key", F.explode(F.sequence("i0", F.col("i1") - 1)).alias("i")).distinct().withColumn("__out", F.lit(True))
    d = rows.join(hit, ["trip_key", "i"], "left")
    return d.withColumn("gnss_available", F.when(F.coalesce("__out", F.lit(False)), 0).otherwise(F.col("gnss_valid").cast("int")).cast("byte")).drop("__out")

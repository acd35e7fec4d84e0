"""Preparation of training data: timelines, statistics, splits, windows, leakage checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series as W
from ..functions.scalar import drive_group
from .numbering import numbered, running

BANNED = ("latitude", "longitude", "gnss_speed", "gnss_heading", "altitude", "reference_latitude", "reference_longitude", "reference_speed", "reference_heading", "reference_x", "reference_y")
FEATURES = ("acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z", "mag_x", "mag_y", "mag_z", "roll", "pitch", "yaw")


def quality_flags(summary: DataFrame) -> DataFrame:
    """Flags of a trip summary: full IMU, short, irregular time, plausible units, mostly moving."""
    return summary.withColumns({
        "flag_has_full_imu": F.coalesce(F.col("imu_valid") > 0.95, F.lit(False)), "flag_short": F.coalesce(F.col("duration_s") < 60, F.lit(False)),
        "flag_time_irregular": F.coalesce(F.col("dt_max_s") > 1.0, F.lit(False)), "flag_acc_units_ok": F.coalesce((F.col("acc_median") > 6) & (F.col("acc_median") < 13), F.lit(False)),
        "flag_mostly_moving": F.coalesce(F.col("frac_stationary") < 0.7, F.lit(False)),
    })


def usable(flags: DataFrame) -> DataFrame:
    """Trips fit for the benchmark. A missing consistency check of a trip without an outage counts as failed."""
    return flags.where(F.col("flag_has_full_imu") & F.col("flag_acc_units_ok") & ~F.col("flag_short") & F.col("flag_mostly_moving") & (F.col("path_len_km") >= 0.3) & F.coalesce(F.col("flag_truth_consistent"), F.lit(False)))


def assign_splits(stats: DataFrame, order: Column | DataFrame, train: float = 0.70, val: float = 0.15, min_s: float = 60.0, min_km: float = 0.3) -> DataFrame:
    """(sequence_id, grp, split): groups of drives are dealt by cumulative duration in a given order (a column, or a table of
    grp and o), so that parts of one drive share a split; groups without a usable part are excluded. A short part takes its group's split."""
    s = stats.withColumn("grp", drive_group(F.col("sequence_id")))
    ok = s.where((F.col("duration_s") >= min_s) & (F.col("path_km") >= min_km)).groupBy("grp").agg(F.sum("duration_s").alias("d"))
    ok = ok.join(order, "grp") if isinstance(order, DataFrame) else ok.withColumn("o", order)
    total = ok.agg(F.sum("d").alias("__all"))
    ok = running(ok, ["o", "grp"], {"__upto": "d"}).crossJoin(F.broadcast(total)).withColumn("at", (F.col("__upto") - F.col("d")) / F.col("__all"))  # one row
    split = F.when(F.col("at") < train, "train").when(F.col("at") < train + val, "val").otherwise("test")
    return s.join(ok.select("grp", split.alias("__s")), "grp", "left").select("sequence_id", "grp", F.coalesce("__s", F.lit("excluded")).alias("split"))


def shuffled(groups: DataFrame, seed: int = 26168) -> DataFrame:
    """groups (grp), distinct, with their place `o` after a seeded shuffle of the sorted names. The driver shuffles numbers, not names."""
    import numpy as np
    import pandas as pd

    named = numbered(groups.select("grp").distinct(), ["grp"], "k")
    places = np.arange(named.count())
    np.random.default_rng(seed).shuffle(places)
    return named.join(groups.sparkSession.createDataFrame(pd.DataFrame({"k": places, "o": np.arange(len(places))}), "k long, o long"), "k").select("grp", "o")


def training_windows(rows: DataFrame, features: list[str], target: str, seconds: float = 2.0, stride: int = 1, max_gap_s: float = 0.6, by: str = "trip_key") -> DataFrame:
    """(by, end, X, y): windows of each sequence's own length, round(seconds * rate) rows and 2 at least, without gaps or missing
    values. X is an array of rows of features.

    Lengths may differ by sequence, a window function's frame may not: sequences are taken by length up to the next power of
    two, and each window is the end of such a frame. One shuffle by sequence, and no row travels to the windows it is part of.
    """
    w = W.over(by)
    d = rows.withColumn("__dt", W.diff(F.col("t"), w))
    rate = d.groupBy(by).agg(F.greatest(F.lit(2), F.bround(F.lit(seconds) / F.median(F.when(F.col("__dt") > 0, F.col("__dt")))).cast("int")).alias("wlen"))
    rate = rate.where("wlen is not null").withColumn("__frame", F.ceil(F.log2("wlen")).cast("int"))
    frames = sorted(r[0] for r in rate.select("__frame").distinct().collect())  # at most 31
    bad = F.coalesce(F.col("__dt") > max_gap_s, F.lit(False)) | F.greatest(*[F.col(c).isNull() for c in features]) | F.col(target).isNull()
    row = F.struct(F.array(*[F.col(c).cast("float") for c in features]).alias("x"), bad.alias("bad"))
    d = d.join(rate, by)
    parts = [d.where(F.col("__frame") == k).withColumn("__rows", F.collect_list(row).over(w.rowsBetween(1 - (1 << k), 0))) for k in frames]
    if not parts:
        parts = [d.withColumn("__rows", F.array(row)).limit(0)]
    wlen, i = F.col("wlen"), F.col("i")
    out = reduce(DataFrame.unionByName, parts).where((i >= wlen - 1) & ((i - wlen + 1) % stride == 0))
    out = out.withColumn("__rows", F.slice("__rows", F.size("__rows") - wlen + 1, wlen)).where(~F.exists("__rows", lambda x: x["bad"]))
    return out.select(by, i.alias("end"), F.transform("__rows", lambda x: x["x"]).alias("X"), F.col(target).cast("float").alias("y"))


def leakage_issues(splits: DataFrame, features: list[str]) -> DataFrame:
    """(issue): sequences or drive groups in several splits, and inputs that are positions or references. No row: PASS."""
    several = lambda key, text: splits.groupBy(key).agg(F.array_sort(F.collect_set("split")).alias("s")).where("size(s) > 1").select(F.concat(F.lit(text), F.col(key), F.lit(" in "), F.array_join("s", ", ")).alias("issue"))
    spark = splits.sparkSession
    bad = spark.range(1).select(F.explode(F.array_sort(F.array_intersect(F.array(*map(F.lit, features)), F.array(*map(F.lit, BANNED))))).alias("f")).select(F.concat(F.lit("input "), F.col("f")).alias("issue"))
    return several("sequence_id", "sequence ").unionByName(several("grp", "drive group ")).unionByName(bad)

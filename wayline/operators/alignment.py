"""Joins of series: by position, by lag, as-of."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_align(left: DataFrame, right: DataFrame, by: str = "trip_key", i: str = "i") -> DataFrame:
    """Rows with equal position in two series of one trip; the longer one is cut."""
    return left.join(right, [by, i])


#: Rows of y that a task correlates at once; longer series are cut into blocks, whose sums are added up.
BLOCK = 1 << 16


def _pair_sums(x: np.ndarray, y: np.ndarray, shifts: np.ndarray, size: int) -> np.ndarray:
    """(shifts, 6): n and the sums of x, y, x*x, y*y, x*y over the pairs y[p], x[(p + shift) mod size], whatever is missing left out.

    Masks of both sides make missing values count nothing, so products of six transforms give all sums of all shifts.
    """
    some, use = np.isfinite(x), np.isfinite(y)
    x, y = np.where(some, x, 0.0), np.where(use, y, 0.0)
    fx = [np.fft.rfft(a, size) for a in (some.astype(float), x, x * x)]
    fy = [np.conj(np.fft.rfft(a, size)) for a in (use.astype(float), y, y * y)]
    sums = [np.fft.irfft(fx[a] * fy[b], size)[shifts] for a, b in ((0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1))]
    sums[0] = np.round(sums[0])
    return np.stack(sums, axis=1)


def lag_correlations(a: DataFrame, lags: list[int], by: str = "trip_key", x: str = "a", y: str = "b", least: int = 200, floor: float = 3.0, where: str | None = None) -> DataFrame:
    """(by, lag, n, r): correlation of x, turned round its series by each lag, with y where y > floor, or where the column
    `where` holds; r is null for fewer than `least` pairs or without spread.

    a: (by, i, x, y), i from 0 without gaps. The sums of all lags come from transforms, at a cost that hardly depends on their number. A
    series of more than BLOCK rows is cut into blocks of y for tasks of their own; a row of x goes to the blocks that its lags reach,
    round the end too. Both columns are shifted by their series' means, which keeps sums exact enough.
    """
    if max(map(abs, lags)) >= BLOCK:
        raise ValueError(f"lags must be below {BLOCK}")
    kind, tried, low_lag, high_lag = a.schema[by].dataType.simpleString(), np.array(lags, np.int64), min(lags), max(lags)
    use = F.coalesce(F.col(where) if where else F.col(y) > floor, F.lit(False))
    finite = lambda c: F.when(~F.isnan(c), F.col(c))
    d = a.select(by, F.col("i").cast("long").alias("i"), F.col(x).cast("double").alias("x"), F.when(use, F.col(y).cast("double")).alias("y"))
    d = d.join(d.groupBy(by).agg(F.count("*").alias("n"), F.avg(finite("x")).alias("mx"), F.avg(finite("y")).alias("my")), by)
    n, i = F.col("n"), F.col("i")
    part = lambda p: F.floor(p / BLOCK)
    reach = []  # places i + lag, before the start and beyond the end too, are those of the series turned round
    for s in (-n, F.lit(0), n):
        first, last = F.greatest(i + low_lag + s, F.lit(0)), F.least(i + high_lag + s, n - 1)
        reach.append(F.when(first <= last, F.sequence(part(first), part(last))).otherwise(F.array().cast("array<bigint>")))
    blocks = F.when(n <= BLOCK, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.concat(F.array(part(i)), *reach)))
    d = d.withColumn("block", F.explode(blocks))

    def turn(pdf: pd.DataFrame) -> pd.DataFrame:
        n, at, i = int(pdf["n"].iloc[0]), int(pdf["block"].iloc[0]) * BLOCK, pdf["i"].to_numpy()
        u, v = pdf["x"].to_numpy(float) - pdf["mx"].iloc[0], pdf["y"].to_numpy(float) - pdf["my"].iloc[0]
        own, mine = np.full(min(BLOCK, n - at), np.nan), i // BLOCK * BLOCK == at
        own[i[mine] - at] = v[mine]
        if n <= BLOCK:
            around = np.full(n, np.nan)
            around[i] = u
            sums = _pair_sums(around, own, -tried % n, n)
        else:
            low = at - high_lag
            around = np.full(len(own) + high_lag - low_lag, np.nan)
            for k in (i - n - low, i - low, i + n - low):
                fits = (k >= 0) & (k < len(around))
                around[k[fits]] = u[fits]
            sums = _pair_sums(around, own, high_lag - tried, 1 << (len(around) - 1).bit_length())
        return pd.DataFrame([(pdf[by].iloc[0], *sums.T)], columns=[by, *cols])

    cols = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    # A row for each block goes through the shuffle, and its lags become rows behind it.
    sums = d.groupBy(by, "block").applyInPandas(turn, f"`{by}` {kind}, " + ", ".join(f"{c} array<double>" for c in cols)).repartition(by)
    sums = sums.select(by, F.explode(F.arrays_zip(F.array(*[F.lit(int(x)) for x in tried]).alias("lag"), *cols)).alias("z")).select(by, F.col("z.lag").alias("lag"), F.col("z.n").cast("long").alias("n"), *[F.col(f"z.{c}").alias(c) for c in cols[1:]])
    s = sums.groupBy(by, "lag").agg(*[F.sum(c).alias(c) for c in cols]).where("n > 0")
    mean = lambda c: F.col(c) / F.col("n")
    vx, vy = mean("sxx") - mean("sx") * mean("sx"), mean("syy") - mean("sy") * mean("sy")
    # Below these, a variance is the rounding of the sums.
    spread = (vx > F.greatest(F.lit(1e-18), 1e-13 * mean("sxx"))) & (vy > F.greatest(F.lit(1e-18), 1e-13 * mean("syy")))
    return s.select(by, "lag", "n", F.when((F.col("n") >= least) & spread, (mean("sxy") - mean("sx") * mean("sy")) / F.sqrt(vx * vy)).alias("r"))


def best_lag(correlations: DataFrame, by: str = "trip_key") -> DataFrame:
    """(by, lag, r): the largest |r|; lag 0 first among equals, then the smallest lag."""
    w = Window.partitionBy(by).orderBy(F.abs(F.round("r", 9)).desc_nulls_last(), (F.col("lag") != 0), "lag")
    return correlations.where("r is not null").withColumn("__k", F.row_number().over(w)).where("__k = 1").select(by, "lag", "r")


def as_of_forward(rows: DataFrame, points: DataFrame, at: str, value: str, by: str = "trip_key") -> DataFrame:
    """points with `found`: the i of the first row whose `value` is at least `at`; null if there is none.

    A union sorted by value, with the next row filled backward: no unequal join.
    """
    r = rows.select(by, F.col(value).alias("__v"), F.col("i").alias("__i"), F.lit(1).alias("__row"))
    keys = [c for c in points.columns if c != by]
    p = points.select(by, F.col(at).alias("__v"), F.struct(*keys).alias("__p"), F.lit(0).alias("__row"))
    both = r.withColumn("__p", F.lit(None).cast(p.schema["__p"].dataType)).unionByName(p.withColumn("__i", F.lit(None).cast(r.schema["__i"].dataType)))
    w = Window.partitionBy(by).orderBy("__v", "__row").rowsBetween(0, Window.unboundedFollowing)
    return both.withColumn("found", F.min("__i").over(w)).where("__row = 0").select(by, "__p.*", "found")


def as_of_backward(rows: DataFrame, value: Column, when: Column, by: str = "trip_key", order: str = "i") -> DataFrame:
    """rows with `latest`: value at the last row up to here where `when` holds."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("latest", F.last(F.when(when, value), ignorenulls=True).over(w))


def resample(rows: DataFrame, period: float, values: list[str], by: str = "trip_key", t: str = "t") -> DataFrame:
    """Uniform ticks between samples, linear in `values`; steps that don't go forward are skipped."""
    w = Window.partitionBy(by).orderBy(t, "i")
    d = rows.withColumns({"__t1": F.lead(t).over(w), **{f"__{v}": F.lead(v).over(w) for v in values}}).where(F.col("__t1") > F.col(t))
    d = d.withColumn("tick", F.explode(F.when(F.ceil(F.col("__t1") / period) - 1 >= F.ceil(F.col(t) / period), F.sequence(F.ceil(F.col(t) / period), F.ceil(F.col("__t1") / period) - 1)).otherwise(F.array().cast("array<bigint>"))))
    alpha = (F.col("tick") * period - F.col(t)) / (F.col("__t1") - F.col(t))
    return d.select(by, "tick", (F.col("tick") * period).alias("t_grid"), (alpha * (F.col("__t1") - F.col(t))).alias("dt_ref"), F.lit(period).alias("dt_grid"), *[(F.col(v) + alpha * (F.col(f"__{v}") - F.col(v))).alias(v) for v in values])

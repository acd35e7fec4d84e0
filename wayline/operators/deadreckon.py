"""Dead reckoning through outages: speed and heading sources, integration, scores. One plan for all trips and sources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import series as W
from .alignment import as_of_forward

KEY = ["trip_key", "window"]
# The pairs of speed and heading source that a benchmark runs.
COMBOS = (("truth", "truth"), ("truth", "veh_yawrate"), ("hold", "truth"), ("obd", "veh_yawrate"), ("wheel_speed", "veh_yawrate"), ("obd", "gps_hold"), ("hold", "imu_aligned"), ("imu_integrate", "imu_aligned"))


def anchors(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """windows with a (row of the anchor, i0 - 1), v0, course0, e0, n0 and t0 there. A positive GPS speed goes before the vehicle's."""
    at = rows.select("trip_key", F.col("i").alias("a"), F.when(F.coalesce(F.col("gps_speed") > 0, F.lit(False)), F.col("gps_speed")).otherwise(F.col("speed")).alias("v0"), F.col("heading_deg").alias("course0"), F.col("e").alias("e0"), F.col("n").alias("n0"), F.col("t").alias("ta"))
    return windows.select("trip_key", "window", "i0", "i1").withColumn("a", F.col("i0") - 1).join(at, ["trip_key", "a"])


def rows_of(rows: DataFrame, intervals: DataFrame, first: str, end: str) -> DataFrame:
    """Each row of a trip once per interval first <= i < end that holds it, with the interval's columns: intervals are spread to
    their places, so the join is on (trip_key, i) and grows with what the intervals hold."""
    places = F.when(F.col(end) > F.col(first), F.sequence(F.col(first), F.col(end) - 1)).otherwise(F.array().cast("array<int>"))
    return rows.join(intervals.withColumn("i", F.explode(places)), ["trip_key", "i"])


def lead_in(rows: DataFrame, anchored: DataFrame, seconds: float) -> DataFrame:
    """Rows of the `seconds` before each outage."""
    w = anchored.select("trip_key", "window", F.col("i0").alias("__i0"), (F.col("ta") - seconds).alias("__ts"))
    first = as_of_forward(rows, w, "__ts", "t").withColumnRenamed("found", "__il")
    return rows_of(rows, first.drop("__ts"), "__il", "__i0").drop("__i0", "__il")


#: Seconds of a trip whose outages share a task.
SPAN_S = 3600.0
_RATE, _GYRO, _PHONE, _WHEEL = "scale double, bias double", "scale double, bias double", "gx double, gy double, gz double, scale double, bias double, quality double", "radius double"


def _dealt(rows: DataFrame, windows: DataFrame, seconds: float, columns: list[str]) -> DataFrame:
    """Rows of the spans where windows begin; the last `seconds` of a span are in the next one too."""
    span = F.floor(F.col("t") / SPAN_S)
    d = rows.select("trip_key", "i", *[F.col(c).cast("double").alias(c) for c in columns])
    d = d.withColumn("span", F.explode(F.array_distinct(F.array(span, F.floor((F.col("t") + seconds) / SPAN_S)))))
    return d.join(windows.select("trip_key", "span").distinct(), ["trip_key", "span"], "left_semi")


@dataclass(frozen=True)
class Fit:
    """run(columns of the `seconds` before an outage, as arrays) gives the values of `out`, or None."""

    seconds: float
    columns: list[str]
    run: Callable[[dict[str, np.ndarray]], tuple | None]
    out: str

    def names(self) -> list[str]:
        return [x.split()[0] for x in self.out.split(", ")]


def _over_lead_ins(rows: DataFrame, anchored: DataFrame, *fits: Fit) -> DataFrame:
    """(trip_key, window, out of each fit): the values of an outage's fits, null for one that gives none; no row where none gives any.

    A task has a span of a trip, the lead-in before it, and all outages that begin there, for all fits at once; overlapping lead-ins are slices of
    the same arrays, so no row is copied or shuffled for each. Times rise with i.
    """
    need = list(dict.fromkeys(["t", *[c for f in fits for c in f.columns]]))
    w = anchored.select("trip_key", "window", "i0", "ta", F.floor(F.col("ta") / SPAN_S).alias("span"))
    d = _dealt(rows, w, max(f.seconds for f in fits), need)
    kind, window = rows.schema["trip_key"].dataType.simpleString(), anchored.schema["window"].dataType.simpleString()
    names = ["trip_key", "window", *[n for f in fits for n in f.names()]]

    def run(key: tuple, pdf: pd.DataFrame, windows: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        i, x, found = pdf["i"].to_numpy(), {c: pdf[c].to_numpy(float) for c in need}, []
        for name, i0, ta in zip(windows["window"], windows["i0"], windows["ta"]):
            made, b = [], int(np.searchsorted(i, i0))
            for f in fits:
                a = int(np.searchsorted(x["t"], ta - f.seconds))
                made.append(f.run({c: x[c][a:b] for c in ("t", *f.columns)}) if b > a else None)
            if any(m is not None for m in made):
                found.append((key[0], name, *[v for m, f in zip(made, fits) for v in (m if m is not None else (None,) * len(f.names()))]))
        return pd.DataFrame(found, columns=names)

    w = w.withColumnsRenamed({"trip_key": "trip", "span": "part"})
    return d.groupBy("trip_key", "span").cogroup(w.groupBy("trip", "part")).applyInPandas(run, f"trip_key {kind}, window {window}, " + ", ".join(f.out for f in fits))


def _true_rate(x: dict[str, np.ndarray]) -> np.ndarray:
    """Turn rate of the true heading in deg/s between rows; missing at the first.

    Half turns lie where the angle wraps, so the side that each falls on is decided by rounding: the steps are those of the SQL.
    """
    h, t = x["heading_deg"], x["t"]
    with np.errstate(divide="ignore", invalid="ignore"):
        rate = np.append(np.nan, (np.fmod(np.fmod(np.diff(h) + 180.0, 360.0) + 360.0, 360.0) - 180.0) / np.diff(t))[: len(t)]
    return np.where(np.isfinite(rate), rate, np.nan)


def _median(v: np.ndarray) -> float:
    v = v[~np.isnan(v)]
    return float(np.median(v)) if len(v) else np.nan


def _line(y: np.ndarray, x: np.ndarray) -> tuple[float, float, float]:
    """Slope and intercept of y by x, and their correlation (missing where either side is constant)."""
    both = ~(np.isnan(x) | np.isnan(y))
    x, y = x[both], y[both]
    if len(x) < 1:
        return np.nan, np.nan, np.nan
    dx, dy = x - x.mean(), y - y.mean()
    xx, yy, xy = (dx * dx).sum(), (dy * dy).sum(), (dx * dy).sum()
    s = xy / xx if xx > 0 else np.nan
    return s, y.mean() - s * x.mean(), xy / np.sqrt(xx * yy) if xx > 0 and yy > 0 else np.nan


def _mean(v: np.ndarray) -> float:
    return float(np.nanmean(v)) if np.any(~np.isnan(v)) else np.nan


def _rate_fit(rate: str = "yaw_rate_dps", seconds: float = 300.0, out: str = _RATE) -> Fit:
    def fit(x: dict[str, np.ndarray]) -> tuple | None:
        true = _true_rate(x)
        some = ~np.isnan(true)
        if not some.any():
            return None
        true, own, dt = true[some], x[rate][some], np.append(np.nan, np.diff(x["t"]))[some]
        straight, turn = np.abs(true) < 1, np.abs(true) > 3
        bias = _median(own[straight]) if straight.sum() > 20 else _median(own)
        r = own - bias
        net, turned = np.nansum(true[turn] * dt[turn]), np.nansum(r[turn] * dt[turn])
        xx = np.nansum(r[turn] ** 2)
        s = net / turned if abs(turned) > 20 else np.nansum(true[turn] * r[turn]) / xx if xx > 0 else np.nan
        return (s if turn.sum() > 30 and 0.2 <= abs(s) <= 5 else 1.0), (None if np.isnan(bias) else bias)

    return Fit(seconds, ["heading_deg", rate], fit, out)


def calibrate_rate(rows: DataFrame, anchored: DataFrame, rate: str = "yaw_rate_dps", seconds: float = 300.0) -> DataFrame:
    """(trip_key, window, scale, bias) of a rate sensor: bias on straights, scale from the turns' net heading."""
    return _over_lead_ins(rows, anchored, _rate_fit(rate, seconds))


def _gyro_fit(gyro_dps: str = "gyro_dps", seconds: float = 60.0, out: str = _GYRO) -> Fit:
    def fit(x: dict[str, np.ndarray]) -> tuple | None:
        true = _true_rate(x)
        some = ~np.isnan(true)
        if not some.any():
            return None
        true, own = true[some], x[gyro_dps][some]
        s, b, _ = _line(true, own)
        if len(true) >= 20 and true.std() > 1.5 and 0.2 <= abs(s) <= 5 and s < 0:
            return s, b
        m = _mean(true + own)
        return -1.0, (0.0 if len(true) < 20 else None if np.isnan(m) else m)

    return Fit(seconds, ["heading_deg", gyro_dps], fit, out)


def calibrate_gyro(rows: DataFrame, anchored: DataFrame, gyro_dps: str = "gyro_dps", seconds: float = 60.0) -> DataFrame:
    """(trip_key, window, scale, bias) of a phone's gyro by least squares over turning lead-ins; else scale -1 and the mean."""
    return _over_lead_ins(rows, anchored, _gyro_fit(gyro_dps, seconds))


def _phone_fit(seconds: float = 60.0, least: int = 30, out: str = _PHONE) -> Fit:
    def fit(x: dict[str, np.ndarray]) -> tuple | None:
        g = np.array([_mean(x[f"grav_{a}"]) for a in "xyz"])
        g = g / np.sqrt((g * g).sum())
        true, z = _true_rate(x), np.degrees(sum(k * x[f"gyro_{a}"] for k, a in zip(g, "xyz")))
        some = (np.abs(true) < 60) & (x["speed"] > 2)
        true, z = true[some], z[some]
        if len(true) < least:
            return None
        s, b, r = _line(true, z)
        ok = z[~np.isnan(z)]
        fine = true.std() > 1 and len(ok) > 0 and ok.std() > 1 and 0.3 < abs(s) < 3
        m = _mean(true + z)
        return (*(None if np.isnan(v) else v for v in g), s if fine else -1.0, b if fine else None if np.isnan(m) else m, 0.0 if np.isnan(r) else r)

    return Fit(seconds, ["heading_deg", "speed", *[f"{k}_{a}" for k in ("grav", "gyro") for a in "xyz"]], fit, out)


def align_phone(rows: DataFrame, anchored: DataFrame, seconds: float = 60.0, least: int = 30) -> DataFrame:
    """(trip_key, window, gx, gy, gz, scale, bias, quality): mean gravity, and the fit of the vertical turn rate to the course.

    Only the third row of the tilt rotation turns the gyro into a turn rate, and that row is the unit gravity itself.
    """
    return _over_lead_ins(rows, anchored, _phone_fit(seconds, least))


def _wheel_fit(seconds: float = 300.0) -> Fit:
    def fit(x: dict[str, np.ndarray]) -> tuple | None:
        some = (x["wheel"] > 1) & (x["speed"] > 1)
        return (float(np.median(x["speed"][some] / x["wheel"][some])) if some.sum() > 20 else 0.30,)

    return Fit(seconds, ["speed", "wheel"], fit, _WHEEL)


def wheel_radius(rows: DataFrame, anchored: DataFrame, seconds: float = 300.0) -> DataFrame:
    """(trip_key, window, radius): metres a second for each unit of the wheel's speed."""
    return _over_lead_ins(rows, anchored, _wheel_fit(seconds))


def level_acceleration() -> Column:
    """Horizontal acceleration by roll and pitch, with the sign of its forward part."""
    cr, sr, cp, sp = F.cos("roll"), F.sin("roll"), F.cos("pitch"), F.sin("pitch")
    ay2, az2 = F.col("acc_y") * cr - F.col("acc_z") * sr, F.col("acc_y") * sr + F.col("acc_z") * cr
    ax2 = F.col("acc_x") * cp + az2 * sp
    return F.when(ax2 < 0, -1.0).otherwise(1.0) * F.sqrt(ax2 * ax2 + ay2 * ay2)


def with_sources(rows: DataFrame, windows: DataFrame, combos=COMBOS, fixed_bias: bool = False, least: int = 30) -> DataFrame:
    """Rows from the anchor to an outage's end with v_<source> and h_<source> of the sources that the combinations name; only
    their calibrations are made. `least`: rows that the phone's alignment needs.

    The rate calibration fits scale * (rate - bias) and by default applies scale * rate + bias; fixed_bias applies what it fits.
    """
    wanted = {f"v_{a}" for a, _ in combos} | {f"h_{b}" for _, b in combos}
    a = anchors(rows, windows)
    d = rows_of(rows, a, "a", "i1")
    w = Window.partitionBy(*KEY).orderBy("i")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    fits = {
        "h_veh_yawrate": lambda: _rate_fit(out="y_scale double, y_bias double"),
        "h_gyro": lambda: _gyro_fit(out="g_scale double, g_bias double"),
        "h_imu_aligned": lambda: _phone_fit(least=least, out="gx double, gy double, gz double, p_scale double, p_bias double, quality double"),
        "v_wheel_speed": _wheel_fit,
    }
    if made := [fit() for name, fit in fits.items() if name in wanted]:
        d = d.join(_over_lead_ins(rows, a, *made), KEY, "left")
    d = d.withColumn("dt", F.coalesce(W.diff(F.col("t"), w), F.lit(0.0)))
    if "v_imu_integrate" in wanted:
        d = d.withColumn("__s", F.sum(level_acceleration() * F.col("dt")).over(up))
    own = F.col("yaw_rate_dps") - F.col("y_bias") if fixed_bias else F.col("yaw_rate_dps")

    def turned(rate: Column) -> Column:
        return F.col("course0") + F.sum(F.coalesce(rate, F.lit(0.0)) * F.col("dt")).over(up)

    sources = {
        "v_truth": lambda: F.col("speed"),
        "v_hold": lambda: F.col("v0"),
        "v_gps_decay": lambda: S.gps_decay(F.col("v0"), F.col("t") - F.col("ta")),
        "v_imu_integrate": lambda: W.reflected_sum(F.col("v0"), F.col("__s"), up),
        "v_obd": lambda: F.coalesce(S.kmh_to_ms(F.col("ind_speed_kmh")), F.col("v0")),
        "v_wheel_speed": lambda: F.col("radius") * F.col("wheel"),
        "h_truth": lambda: F.col("heading_deg"),
        "h_gps_hold": lambda: F.col("course0"),
        "h_veh_yawrate": lambda: turned(F.col("y_scale") * own + (0.0 if fixed_bias else F.col("y_bias"))),
        "h_gyro": lambda: turned(F.col("g_scale") * F.col("gyro_dps") + F.col("g_bias")),
        "h_imu_aligned": lambda: turned(F.when(F.abs("quality") >= 0.4, F.col("p_scale") * F.degrees(F.col("gx") * F.col("gyro_x") + F.col("gy") * F.col("gyro_y") + F.col("gz") * F.col("gyro_z")) + F.col("p_bias"))),
    }
    limit = lambda x: F.greatest(F.lit(0.0), F.least(x, F.lit(90.0)))
    return d.withColumns({k: limit(f()) if k.startswith("v_") else f() for k, f in sources.items() if k in wanted}).drop("__s")


def dead_reckon(sourced: DataFrame, combos=COMBOS) -> DataFrame:
    """Tracks of every combination: (trip_key, window, speed_source, heading_source, i, t, e_est, n_est, e, n, err, path, v_est, speed)."""
    pairs = F.array(*[F.struct(F.lit(a).alias("s"), F.lit(b).alias("h"), F.col(f"v_{a}").alias("v"), F.radians(f"h_{b}").alias("c")) for a, b in combos])
    d = sourced.select(*KEY, "i", "t", "dt", "e", "n", "e0", "n0", "speed", F.explode(pairs).alias("p"))
    d = d.select(*KEY, "i", "t", "dt", "e", "n", "e0", "n0", "speed", F.col("p.s").alias("speed_source"), F.col("p.h").alias("heading_source"), F.col("p.v").alias("v_est"), (F.col("p.v") * F.sin("p.c")).alias("ve"), (F.col("p.v") * F.cos("p.c")).alias("vn"))
    w = Window.partitionBy(*KEY, "speed_source", "heading_source").orderBy("i")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"__se": F.coalesce(W.trapezoid(F.col("ve"), F.col("dt"), w), F.lit(0.0)), "__sn": F.coalesce(W.trapezoid(F.col("vn"), F.col("dt"), w), F.lit(0.0)), "__st": F.coalesce(F.sqrt(W.diff(F.col("e"), w) ** 2 + W.diff(F.col("n"), w) ** 2), F.lit(0.0))})
    d = d.withColumns({"e_est": F.col("e0") + F.sum("__se").over(up), "n_est": F.col("n0") + F.sum("__sn").over(up), "path": F.sum("__st").over(up)})
    return d.withColumn("err", F.sqrt((F.col("e_est") - F.col("e")) ** 2 + (F.col("n_est") - F.col("n")) ** 2)).drop("__se", "__sn", "__st", "ve", "vn", "e0", "n0", "dt")


def drift_metrics(tracks: DataFrame) -> DataFrame:
    """Final, largest and RMS error, drift in percent of the path, speed error, and the 10 percent rule."""
    w = Window.partitionBy(*KEY, "speed_source", "heading_source").orderBy("i")
    ve, vn = W.gradient(F.col("e"), F.col("t"), w), W.gradient(F.col("n"), F.col("t"), w)
    d = tracks.withColumn("__v", F.sqrt(ve * ve + vn * vn))
    pct = F.col("final_m") * 100 / F.greatest(F.col("path_m"), F.lit(1e-6))
    m = d.groupBy(*KEY, "speed_source", "heading_source").agg(F.max_by("err", "i").alias("final_m"), F.max("err").alias("max_m"), F.sqrt(F.avg(F.col("err") ** 2)).alias("rmse_m"), F.max_by("path", "i").alias("path_m"), (F.max("t") - F.min("t")).alias("span_s"), F.avg(F.abs(F.col("v_est") - F.col("__v"))).alias("__mae"))
    m = m.withColumn("drift_pct", pct)
    return m.withColumns({"drift_rate": F.col("final_m") / F.greatest(F.col("span_s"), F.lit(1e-6)), "passed": F.col("drift_pct") <= 10, "speed_mae": F.when(F.col("speed_source") != "truth", F.col("__mae"))}).drop("__mae")


def summarise(metrics: DataFrame) -> DataFrame:
    """Per combination: runs, pass rate, median and 90th percentile of drift and final error."""
    return metrics.groupBy("speed_source", "heading_source").agg(F.count("*").alias("n"), F.avg(F.col("passed").cast("double")).alias("pass_rate"), F.median("drift_pct").alias("median_pct"), F.percentile("drift_pct", 0.9).alias("p90_pct"), F.median("final_m").alias("median_final_m"))


def nhc_dead_reckoner(rows: DataFrame) -> DataFrame:
    """Incremental reckoner of a whole series: mean heading and speed of each step; uncertainty grows by 0.8 m/s."""
    w = W.over()
    h = F.radians("heading_deg")
    avg = S.angle_avg(F.lag(h).over(w), h)
    dist = (F.lag("speed").over(w) + F.col("speed")) * 0.5 * W.diff(F.col("t"))
    d = rows.withColumns({"__e": F.coalesce(dist * F.sin(avg), F.lit(0.0)), "__n": F.coalesce(dist * F.cos(avg), F.lit(0.0))})
    return d.select("trip_key", "i", W.cum(F.col("__e")).alias("east"), W.cum(F.col("__n")).alias("north"), ((F.col("t") - F.first("t").over(W.upto())) * 0.8).alias("std_m"))

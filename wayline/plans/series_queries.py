"""Queries of the window functions, filters, joins and aggregates, over the signal view."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import scalar as S
from ..functions import series as W
from ..operators import alignment, numbering, outage
from ..sources.signals import GAP_S, signals
from .registry import query, rounded

_PMOD = lambda x, m: f"((({x}) % {m} + {m}) % {m})"
_HAV = "2 * 6378137.0::double * asin(sqrt(least(greatest(pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2), 0.0::double), 1.0::double)))"
STEP = f", st as (select *, {_HAV} as step from (select *, lag(lat) over w as plat, lag(lon) over w as plon, lag(t) over w as pt, lag(speed) over w as pspeed from sig window w as (partition by trip_key order by i)))\n"
R = lambda x, n=6: f"round({x}, {n}) + 0.0::double"
OVER = "over (partition by trip_key order by i)"
UPTO = "over (partition by trip_key order by i rows between unbounded preceding and current row)"
_c = F.col


def _rows(name, sql, places=6):
    """Register a query of window columns: the function gives {name: column} of the signal view."""

    def add(f):
        def run(spark, sf_dir):
            d = signals(spark, sf_dir)
            out = f(d)
            if isinstance(out, tuple):
                d, out = out
            return d.select("trip_key", "i", *[(rounded(x, places) if places else x).alias(k) for k, x in out.items()])

        query(name, sql)(run)
        return f

    return add


@_rows("w01_first_difference", f"select trip_key, i, {R(f'speed - lag(speed) {OVER}')} as d from sig")
def w01(d):
    return {"d": W.diff(_c("speed"))}


@_rows("w02_cumulative_distance", f"{STEP}select trip_key, i, {R(f'sum(coalesce(step, 0)) {UPTO}', 4)} as dist from st", 4)
def w02(d):
    return d.withColumn("s", F.coalesce(W.step_m(_c("lat"), _c("lon")), F.lit(0.0))), {"dist": W.cum(_c("s"))}


_ENU0 = ", o as (select *, first_value(lat) over (partition by trip_key order by i) as lat0, first_value(lon) over (partition by trip_key order by i) as lon0 from sig), en as (select *, radians(lon - lon0) * 6378137.0::double * cos(radians(lat0)) as e, radians(lat - lat0) * 6378137.0::double as n from o)\n"


def _enu(d):
    w = W.over().rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"lat0": F.first("lat").over(w), "lon0": F.first("lon").over(w)})
    e, n = S.to_enu(_c("lat"), _c("lon"), _c("lat0"), _c("lon0"))
    return d.withColumns({"e": e, "n": n})


@_rows("p07_enu_row0_origin", f"{_ENU0}select trip_key, i, {R('e', 4)} as e, {R('n', 4)} as n from en", 4)
def p07(d):
    return _enu(d), {"e": _c("e"), "n": _c("n")}


_VALID0 = ", v as (select *, row_number() over (partition by trip_key order by case when gnss_valid then 0 else 1 end, i) as rk from sig), o as (select trip_key, lat as lat0, lon as lon0 from v where rk = 1 and gnss_valid)\n"


@_rows("p06_enu_first_valid_origin", f"{_VALID0}select s.trip_key, s.i, {R('radians(lon - lon0) * 6378137.0::double * cos(radians(lat0))', 4)} as e, {R('radians(lat - lat0) * 6378137.0::double', 4)} as n from sig s left join o on o.trip_key = s.trip_key", 4)
def p06(d):
    d = d.withColumn("o", W.first_valid(F.struct("lat", "lon"), _c("gnss_valid")))
    e, n = S.to_enu(_c("lat"), _c("lon"), _c("o.lat"), _c("o.lon"))
    return d, {"e": e, "n": n}


@_rows("w03_cumulative_planar_distance", f"{_ENU0}, h as (select *, sqrt(pow(e - lag(e) {OVER}, 2) + pow(n - lag(n) {OVER}, 2)) as step from en) select trip_key, i, {R(f'sum(coalesce(step, 0)) {UPTO}', 4)} as dist from h", 4)
def w03(d):
    d = _enu(d).withColumn("s", F.coalesce(F.sqrt(W.diff(_c("e")) ** 2 + W.diff(_c("n")) ** 2), F.lit(0.0)))
    return d, {"dist": W.cum(_c("s"))}


@_rows("w04_forward_fill", f"select trip_key, i, {R(f'last_value(case when gnss_valid then t end ignore nulls) {UPTO}')} as t_fix from sig")
def w04(d):
    return {"t_fix": W.forward_fill(F.when(_c("gnss_valid"), _c("t")))}


_SINCE = "over (partition by trip_key order by i rows between current row and unbounded following)"


@_rows("w05_linear_interpolation", f", m as (select *, case when k % 4 = 0 then speed end as x from sig), f as (select *, last_value(x ignore nulls) {UPTO} as x0, last_value(case when x is not null then i end ignore nulls) {UPTO} as i0, first_value(x ignore nulls) {_SINCE} as x1, first_value(case when x is not null then i end ignore nulls) {_SINCE} as i1 from m)\nselect trip_key, i, {R('coalesce(x, case when i1 > i0 then x0 + (x1 - x0) * (i - i0) / (i1 - i0) end, x0, x1)')} as v from f")
def w05(d):
    d = d.withColumn("x", F.when(_c("k") % 4 == 0, _c("speed")))
    return d, {"v": W.interpolate(_c("x"), _c("i"))}


_GRAD = lambda f, src: f", g as (select *, lag({f}) {OVER} as f0, lead({f}) {OVER} as f1, t - lag(t) {OVER} as a, lead(t) {OVER} - t as b from {src})\n"
_GEXP = lambda f: f"case when f0 is null then (f1 - {f}) / b when f1 is null then ({f} - f0) / a else (a * a * f1 + (b * b - a * a) * {f} - b * b * f0) / (a * b * (a + b)) end"


@_rows("w06_gradient", _GRAD("speed", "sig") + f"select trip_key, i, {R(_GEXP('speed'), 4)} as g from g", 4)
def w06(d):
    return {"g": W.gradient(_c("speed"), _c("t"))}


@_rows("w07_velocity_target", _ENU0 + _GRAD("n", "en") + f"select trip_key, i, {R(_GEXP('n'), 3)} as vn from g", 3)
def w07(d):
    d = _enu(d)
    return d, {"vn": W.gradient(_c("n"), _c("t"))}


@_rows("w08_centred_moving_avg", f"select trip_key, i, {R('sum(speed) over (partition by trip_key order by i rows between 10 preceding and 9 following) / 20.0::double')} as v from sig")
def w08(d):
    return {"v": W.smooth(_c("speed"))}


@_rows("w09_first_valid_origin", f"{_VALID0}select s.trip_key, s.i, {R('lat0', 8)} as lat0, {R('lon0', 8)} as lon0 from sig s left join o on o.trip_key = s.trip_key", 8)
def w09(d):
    d = d.withColumn("o", W.first_valid(F.struct("lat", "lon"), _c("gnss_valid")))
    return d, {"lat0": _c("o.lat"), "lon0": _c("o.lon")}


_UNW = f", d1 as (select *, heading_deg - lag(heading_deg) {OVER} as d from sig), d2 as (select *, {_PMOD('d + 180', '360.0::double')} - 180 as w from d1), d3 as (select *, case when abs(d) < 180 or d is null then 0 when w = -180 and d > 0 then 180 - d else w - d end as fix from d2)\n"


@_rows("w10_angle_unwrap", f"{_UNW}select trip_key, i, {R(f'heading_deg + sum(fix) {UPTO}', 4)} as h from d3", 4)
def w10(d):
    d = d.withColumn("s", F.coalesce(W.unwrap_step(_c("heading_deg")), F.lit(0.0)))
    return d, {"h": _c("heading_deg") + W.cum(_c("s"))}


@_rows("w11_heading_integral", f"{STEP}select trip_key, i, {R(f'90 + sum(coalesce(gyro_z * (t - pt), 0)) {UPTO}', 4)} as h from st", 4)
def w11(d):
    d = d.withColumn("s", F.coalesce(_c("gyro_z") * W.diff(_c("t")), F.lit(0.0)))
    return d, {"h": W.cum(_c("s")) + 90}


@_rows("w12_trapezoid_position", f"{STEP}, v as (select *, speed * sin(radians(heading_deg)) as ve, speed * cos(radians(heading_deg)) as vn from st), u as (select *, (ve + lag(ve) {OVER}) * 0.5::double * (t - pt) as se, (vn + lag(vn) {OVER}) * 0.5::double * (t - pt) as sn from v) select trip_key, i, {R(f'sum(coalesce(se, 0)) {UPTO}', 4)} as e, {R(f'sum(coalesce(sn, 0)) {UPTO}', 4)} as n from u", 4)
def w12(d):
    d = d.withColumns({"ve": _c("speed") * F.sin(F.radians("heading_deg")), "vn": _c("speed") * F.cos(F.radians("heading_deg")), "dt": W.diff(_c("t"))})
    d = d.withColumns({"se": F.coalesce(W.trapezoid(_c("ve"), _c("dt")), F.lit(0.0)), "sn": F.coalesce(W.trapezoid(_c("vn"), _c("dt")), F.lit(0.0))})
    return d, {"e": W.cum(_c("se")), "n": W.cum(_c("sn"))}


@_rows("w13_reflected_speed", f"{STEP}, s as (select *, sum(coalesce(acc_x * (t - pt), 0)) {UPTO} as ss from st) select trip_key, i, {R(f'ss + greatest(2.0::double, -min(ss) {UPTO})')} as v from s")
def w13(d):
    d = d.withColumn("dt", W.diff(_c("t"))).withColumn("ss", W.cum(F.coalesce(_c("acc_x") * _c("dt"), F.lit(0.0))))
    return d, {"v": W.reflected_sum(F.lit(2.0), _c("ss"))}


_EPOCH = f", e as (select *, sum(case when abs(acc_x) > 1.9 then 1 else 0 end) {UPTO} as epoch from sig)\n"


@_rows("w14_rolling_window", f"{_EPOCH}select trip_key, i, {R('avg(speed) over (partition by trip_key, epoch order by i rows between 59 preceding and current row)', 9)} as mean, count(*) over (partition by trip_key, epoch order by i rows between 59 preceding and current row) + 0.0::double as n from e", 9)
def w14(d):
    d = d.withColumn("epoch", W.cum((F.abs("acc_x") > 1.9).cast("long")))
    w = Window.partitionBy("trip_key", "epoch").orderBy("i").rowsBetween(-59, 0)
    return d, {"mean": F.avg("speed").over(w), "n": F.count("*").over(w).cast("double")}


@_rows("w16_displacement_target", f"{_ENU0}, l as (select *, lead(e, 5) {OVER} - e as de, sum(case when t - pt > 5 then 1 else 0 end) over (partition by trip_key order by i rows between 1 following and 5 following) as gaps from (select *, lag(t) {OVER} as pt from en)) select trip_key, i, {R('case when gaps = 0 then de end', 4)} as de from l", 4)
def w16(d):
    d = _enu(d).withColumn("g", F.coalesce(W.diff(_c("t")) > GAP_S, F.lit(False)).cast("int"))
    return d, {"de": F.when(F.sum("g").over(W.over().rowsBetween(1, 5)) == 0, F.lead("e", 5).over(W.over()) - _c("e"))}


_ISL = f", a as (select *, case when gnss_valid = lag(gnss_valid) {OVER} then 0 else 1 end as c from sig), b as (select *, sum(c) {UPTO} as island from a), r as (select *, row_number() over (partition by trip_key, island order by i) as streak from b), h as (select *, last_value(case when not gnss_valid and streak >= 5 then 0 when gnss_valid and streak >= 2 then 1 end ignore nulls) {UPTO} as st from r)\n"


def _hysteresis(d):
    d = d.withColumn("island", W.islands(_c("gnss_valid")))
    d = d.withColumn("streak", F.row_number().over(Window.partitionBy("trip_key", "island").orderBy("i")))
    return d.withColumn("st", W.forward_fill(F.when(~_c("gnss_valid") & (_c("streak") >= 5), 0).when(_c("gnss_valid") & (_c("streak") >= 2), 1)))


@_rows("w17_hysteresis", f"{_ISL}select trip_key, i, coalesce(st, 1) as valid, streak from h", None)
def w17(d):
    return _hysteresis(d), {"valid": F.coalesce("st", F.lit(1)), "streak": _c("streak")}


@_rows("w18_reacquisition", f"{_ISL}select trip_key, i, coalesce(coalesce(st, 1) = 1 and lag(coalesce(st, 1)) {OVER} = 0, false) as back from h", None)
def w18(d):
    d = _hysteresis(d).withColumn("v", F.coalesce("st", F.lit(1)))
    return d, {"back": F.coalesce((_c("v") == 1) & (F.lag("v").over(W.over()) == 0), F.lit(False))}


@_rows("w19_hold_timeout", f", h as (select *, last_value(case when k % 20 = 0 then t end ignore nulls) {UPTO} as fix from sig), x as (select *, coalesce(t - fix > 10, false) as hold from h) select trip_key, i, hold, {R('case when hold then first_value(case when hold then speed end ignore nulls) over (partition by trip_key, fix order by i rows between unbounded preceding and unbounded following) else speed end')} as v from x", None)
def w19(d):
    d = d.withColumn("fix", W.forward_fill(F.when(_c("k") % 20 == 0, _c("t")))).withColumn("hold", F.coalesce(_c("t") - _c("fix") > 10, F.lit(False)))
    w = Window.partitionBy("trip_key", "fix").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return d, {"hold": _c("hold"), "v": rounded(F.when(_c("hold"), F.first(F.when(_c("hold"), _c("speed")), True).over(w)).otherwise(_c("speed")))}


@query("w20_circular_shift", f", n as (select *, count(*) over (partition by trip_key) as n from sig) select a.trip_key, a.i, {R('b.speed')} as v from n a join n b on b.trip_key = a.trip_key and b.i = (((a.i - 7) % a.n + a.n) % a.n)")
def w20(spark, sf_dir):
    d = signals(spark, sf_dir).select("trip_key", "i", "speed").withColumn("n", F.count("*").over(Window.partitionBy("trip_key")))
    b = d.select("trip_key", F.pmod(_c("i") + 7, _c("n")).alias("i"), _c("speed").alias("v"))
    return d.join(b, ["trip_key", "i"]).select("trip_key", "i", rounded(_c("v")).alias("v"))


@_rows("w21_row_index", "select trip_key, i, cast(i as bigint) as idx from sig", None)
def w21(d):
    return {"idx": _c("i").cast("long")}


# ---------------------------------------------------------------- filters

_NATIVE = f", z as (select *, coalesce(lat <> lag(lat) {OVER} or lon <> lag(lon) {OVER}, true) as nw from sig), y as (select *, t - last_value(case when nw then t end ignore nulls) {UPTO} as since from z)\n"
query("f01_native_validity", f"{_NATIVE}select trip_key, i, (lat between -90 and 90 and lon between -180 and 180 and not (lat = 0 and lon = 0)) and not coalesce(since > 12 and speed > 3, false) as native_valid from y")(lambda s, d: outage.native_validity(signals(s, d)).select("trip_key", "i", "native_valid"))


@query("f07_finite_filter", ", b as (select *, sum(case when k % 17 = 0 then 1 else 0 end) over (partition by trip_key order by i rows between 9 preceding and current row) as bad from sig) select trip_key, i from b where bad = 0 and i >= 9")
def f07(spark, sf_dir):
    d = signals(spark, sf_dir).withColumn("x", F.when(_c("k") % 17 != 0, _c("speed")))
    return d.withColumn("bad", F.sum(_c("x").isNull().cast("int")).over(W.over().rowsBetween(-9, 0))).where("bad = 0 and i >= 9").select("trip_key", "i")


@query("f08_gap_free_filter", f", g as (select *, case when t - lag(t) {OVER} > 5 then 1 else 0 end as gap from sig), b as (select *, sum(gap) over (partition by trip_key order by i rows between 9 preceding and current row) as bad from g) select trip_key, i from b where bad = 0 and i >= 9")
def f08(spark, sf_dir):
    d = signals(spark, sf_dir).withColumn("gap", F.coalesce(W.diff(_c("t")) > GAP_S, F.lit(False)).cast("int"))
    return d.withColumn("bad", F.sum("gap").over(W.over().rowsBetween(-9, 0))).where("bad = 0 and i >= 9").select("trip_key", "i")


# ---------------------------------------------------------------- joins

_LAGS = lambda a, b, s: f"unnest(range({a}, {b}, {s}))"


def _lag_query(name, lags, least, floor):
    values = ", ".join(f"({x})" for x in lags)
    sql = f", n as (select trip_key, i, speed as a, value / 10.0::double + gyro_z as b, count(*) over (partition by trip_key) as n from sig), l(lag) as (values {values}), m as (select trip_key, lag, a, (((i + lag) % n + n) % n) as at from n, l), p as (select m.trip_key, m.lag, m.a, n.b from m join n on n.trip_key = m.trip_key and n.i = m.at where n.b > {floor}), c as (select trip_key, lag, count(*) as n, corr(a, b) as r, least(stddev_pop(a), stddev_pop(b)) as sp from p group by trip_key, lag), q as (select *, row_number() over (partition by trip_key order by abs(round(r, 9)) desc, case when lag = 0 then 0 else 1 end, lag) as rk from c where n >= {least} and sp > 1e-9) select trip_key, lag, {R('r')} as r from q where rk = 1"

    @query(name, sql)
    def run(spark, sf_dir):
        d = signals(spark, sf_dir).select("trip_key", "i", _c("speed").alias("a"), (_c("value") / 10.0 + _c("gyro_z")).alias("b"))
        out = alignment.best_lag(alignment.lag_correlations(d, lags, least=least, floor=floor))
        return out.select("trip_key", "lag", rounded(_c("r")).alias("r"))


_lag_query("j03_lag_correlation", list(range(-60, 61)), 30, 3.0)
_lag_query("j04_best_lag", list(range(-20, 21, 2)), 20, 0.0)


@query("j01_row_alignment", "select a.trip_key, a.i, a.speed, b.heading_deg from sig a join sig b on b.trip_key = a.trip_key + 1 and b.i = a.i")
def j01(spark, sf_dir):
    d = signals(spark, sf_dir)
    other = d.select((_c("trip_key") - 1).alias("trip_key"), "i", "heading_deg")
    return alignment.row_align(d.select("trip_key", "i", "speed"), other).select("trip_key", "i", "speed", "heading_deg")


@query("j02_timeline_alignment", f"select a.trip_key, a.i, {R('a.t')} as t, {R('b.speed')} as reference_speed from sig a join sig b on b.trip_key = a.trip_key + 1 and b.i = a.i")
def j02(spark, sf_dir):
    d = signals(spark, sf_dir)
    ref = d.select((_c("trip_key") - 1).alias("trip_key"), "i", _c("speed").alias("reference_speed"))
    return alignment.row_align(d.select("trip_key", "i", "t"), ref).select("trip_key", "i", rounded(_c("t")).alias("t"), rounded(_c("reference_speed")).alias("reference_speed"))


@query("j05_as_of_time", ", p(target) as (values (10.0::double), (30.0::double), (65.0::double)), k as (select distinct trip_key from sig) select k.trip_key, p.target, min(s.i) as found from k cross join p left join sig s on s.trip_key = k.trip_key and s.t >= p.target group by k.trip_key, p.target")
def j05(spark, sf_dir):
    d = signals(spark, sf_dir)
    p = d.select("trip_key").distinct().withColumn("target", F.explode(F.array(*map(F.lit, [10.0, 30.0, 65.0]))))
    return alignment.as_of_forward(d, p, "target", "t").select("trip_key", "target", "found")


@query("j06_as_of_distance", f"{STEP}, ds as (select *, round(sum(coalesce(step, 0)) {UPTO}, 3) as dist from st), k as (select distinct trip_key from sig) select k.trip_key, min(s.i) as found from k left join ds s on s.trip_key = k.trip_key and s.dist >= 20000.5 group by k.trip_key")
def j06(spark, sf_dir):
    d = signals(spark, sf_dir).withColumn("s", F.coalesce(W.step_m(_c("lat"), _c("lon")), F.lit(0.0))).withColumn("dist", F.round(W.cum(_c("s")), 3))
    p = d.select("trip_key").distinct().withColumn("target", F.lit(20000.5))
    return alignment.as_of_forward(d, p, "target", "dist").select("trip_key", "found")


@query("j09_latest_fix", f"select trip_key, i, {R(f'last_value(case when gnss_valid then speed end ignore nulls) {UPTO}')} as v from sig")
def j09(spark, sf_dir):
    return alignment.as_of_backward(signals(spark, sf_dir), _c("speed"), _c("gnss_valid")).select("trip_key", "i", rounded(_c("latest")).alias("v"))


@query("j16_resample", f", l as (select *, lead(t) over (partition by trip_key order by t, i) as t1, lead(speed) over (partition by trip_key order by t, i) as s1 from sig), x as (select *, unnest(range(cast(ceil(t / 0.5::double) as bigint), cast(ceil(t1 / 0.5::double) as bigint))) as tick from l where t1 > t) select trip_key, tick, {R('speed + (tick * 0.5::double - t) / (t1 - t) * (s1 - speed)')} as speed from x")
def j16(spark, sf_dir):
    return alignment.resample(signals(spark, sf_dir), 0.5, ["speed"]).select("trip_key", "tick", rounded(_c("speed")).alias("speed"))


# ---------------------------------------------------------------- aggregates

def _per_trip(name, sql, places=6):
    def add(f):
        def run(spark, sf_dir):
            d = signals(spark, sf_dir)
            d, aggs = f(d)
            return d.groupBy("trip_key").agg(*[(rounded(x, places) if places else x).alias(k) for k, x in aggs.items()])

        query(name, sql)(run)
        return f

    return add


_DT = f", q as (select *, t - lag(t) {OVER} as dt from sig)\n"


@_per_trip("a01_inventory_stats", f"{_DT}select trip_key, count(*) as n, sum(case when k % 7 = 0 then 1 else 0 end) as missing, round(max(t) - min(t), 6) as duration, round(median(case when dt > 0 then dt end), 6) as dt, sum(case when dt = 0 then 1 else 0 end) as dup, round(max(dt), 6) as gap from q group by trip_key", None)
def a01(d):
    d = d.withColumn("dt", W.diff(_c("t")))
    return d, {"n": F.count("*"), "missing": F.sum((_c("k") % 7 == 0).cast("long")), "duration": F.round(F.max("t") - F.min("t"), 6), "dt": F.round(F.median(F.when(_c("dt") > 0, _c("dt"))), 6), "dup": F.sum(F.when(_c("dt") == 0, 1).otherwise(0)), "gap": F.round(F.max("dt"), 6)}


@_per_trip("a02_sequence_stats", f"{_DT}select trip_key, {R('avg(speed)')} as mean_speed, {R('max(speed)')} as max_speed, {R('avg(case when speed < 0.5 then 1.0::double else 0.0::double end)')} as stationary, {R('1 / median(case when dt > 0 then dt end)', 4)} as hz, {R('sum(case when dt > 5 then 1 else 0 end)')} as gaps from q group by trip_key")
def a02(d):
    d = d.withColumn("dt", W.diff(_c("t")))
    return d, {"mean_speed": F.avg("speed"), "max_speed": F.max("speed"), "stationary": F.avg((_c("speed") < 0.5).cast("double")), "hz": F.round(1 / F.median(F.when(_c("dt") > 0, _c("dt"))), 4), "gaps": F.sum(F.coalesce(_c("dt") > GAP_S, F.lit(False)).cast("double"))}


@query("a03_gnss_interval", f", z as (select *, coalesce(lat <> lag(lat) {OVER}, true) as nw from sig), y as (select trip_key, t - lag(t) {OVER} as dt from z where nw) select trip_key, {R('median(dt)')} as interval_s from y group by trip_key")
def a03(spark, sf_dir):
    d = signals(spark, sf_dir).withColumn("nw", F.coalesce(_c("lat") != F.lag("lat").over(W.over()), F.lit(True))).where("nw")
    return d.withColumn("dt", W.diff(_c("t"))).groupBy("trip_key").agg(rounded(F.median("dt")).alias("interval_s"))


@_per_trip("a04_trip_summary", f"{STEP}select trip_key, count(*) + 0.0::double as n, {R('max(t) - min(t)')} as duration_s, {R('sum(coalesce(step, 0)) / 1000', 3)} as path_km, {R('avg(speed) * 3.6')} as mean_kmh, {R('max(speed) * 3.6')} as max_kmh, {R('quantile_cont(t - pt, 0.95)')} as dt_p95, {R('avg(sqrt(acc_x * acc_x + acc_y * acc_y + acc_z * acc_z))')} as acc_norm, {R('quantile_cont(abs(gyro_z), 0.95)')} as gyro_p95 from st group by trip_key")
def a04(d):
    d = d.withColumns({"dt": W.diff(_c("t")), "s": F.coalesce(W.step_m(_c("lat"), _c("lon")), F.lit(0.0))})
    return d, {"n": F.count("*").cast("double"), "duration_s": F.max("t") - F.min("t"), "path_km": F.round(F.sum("s") / 1000, 3), "mean_kmh": F.avg("speed") * 3.6, "max_kmh": F.max("speed") * 3.6, "dt_p95": F.percentile("dt", 0.95), "acc_norm": F.avg(F.sqrt(_c("acc_x") ** 2 + _c("acc_y") ** 2 + _c("acc_z") ** 2)), "gyro_p95": F.percentile(F.abs("gyro_z"), 0.95)}


@_per_trip("a07_quality_report", f"{_DT}select trip_key, count(*) as n, sum(case when dt = 0 then 1 else 0 end) as dup, sum(case when dt < 0 then 1 else 0 end) as backward, sum(case when dt > 5 then 1 else 0 end) as gaps, round(max(abs(acc_z)), 6) as acc_max, max(abs(acc_z)) > 60 as acc_extreme, max(speed) > 75 as impossible from q group by trip_key", None)
def a07(d):
    d = d.withColumn("dt", W.diff(_c("t")))
    flag = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return d, {"n": F.count("*"), "dup": flag(_c("dt") == 0), "backward": flag(_c("dt") < 0), "gaps": flag(_c("dt") > GAP_S), "acc_max": F.round(F.max(F.abs("acc_z")), 6), "acc_extreme": F.max(F.abs("acc_z")) > 60, "impossible": F.max("speed") > 75}


@_per_trip("a08_constant_channels", "select trip_key, case when stddev_pop(case when trip_key % 3 = 0 then 1.0::double else speed end) < 1e-9 then 'a' else '-' end as names from sig group by trip_key", None)
def a08(d):
    d = d.withColumns({"a": F.when(_c("trip_key") % 3 == 0, 1.0).otherwise(_c("speed")), "b": _c("gyro_z") + _c("i")})
    names = F.array_join(F.filter(F.array(*[F.when(F.stddev_pop(x) < 1e-9, F.lit(x)) for x in ("a", "b")]), lambda x: x.isNotNull()), ",")
    return d, {"names": F.when(names == "", "-").otherwise(names)}


@_per_trip("a13_rmse", f"select trip_key, {R('sqrt(avg(pow(speed - abs(acc_x) * 10, 2)))')} as rmse from sig where k % 7 <> 0 group by trip_key")
def a13(d):
    p = F.when(_c("k") % 7 != 0, F.abs("acc_x") * 10)
    return d, {"rmse": F.sqrt(F.avg((_c("speed") - p) ** 2))}


@_per_trip("a14_mae", f"select trip_key, {R('avg(abs(speed - abs(acc_x) * 10))')} as mae from sig where k % 7 <> 0 group by trip_key")
def a14(d):
    p = F.when(_c("k") % 7 != 0, F.abs("acc_x") * 10)
    return d, {"mae": F.avg(F.abs(_c("speed") - p))}


@_per_trip("a16_path_length", f"{STEP}select trip_key, {R('sum(coalesce(step, 0))', 4)} as m from st group by trip_key", 4)
def a16(d):
    return d.withColumn("s", F.coalesce(W.step_m(_c("lat"), _c("lon")), F.lit(0.0))), {"m": F.sum("s")}


@_per_trip("a17_route_length", f"{STEP}select trip_key, {R('sum(coalesce(step, 0)) * 6371000 / 6378137', 3)} as m from st group by trip_key", 3)
def a17(d):
    w = W.over()
    return d.withColumn("s", S.haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), _c("lat"), _c("lon"), S.EARTH_MEAN_M)), {"m": F.sum("s")}


@_per_trip("a18_pearson", f"select trip_key, {R('case when count(*) >= 3 and stddev_pop(speed) > 1e-6 and stddev_pop(gyro_z) > 1e-6 then corr(speed, gyro_z) end')} as r from sig group by trip_key")
def a18(d):
    return d, {"r": F.when((F.count("*") >= 3) & (F.stddev_pop("speed") > 1e-6) & (F.stddev_pop("gyro_z") > 1e-6), F.corr("speed", "gyro_z"))}


@_per_trip("a19_ols_alignment", f"select trip_key, {R('case when abs(regr_slope(heading_deg, value)) between 0.3 and 3 then regr_slope(heading_deg, value) else -1 end')} as slope, {R('case when abs(regr_slope(heading_deg, value)) between 0.3 and 3 then regr_intercept(heading_deg, value) else avg(heading_deg + value) end', 4)} as bias from sig group by trip_key")
def a19(d):
    s = F.regr_slope("heading_deg", "value")
    fine = F.abs(s).between(0.3, 3)
    return d, {"slope": F.when(fine, s).otherwise(-1.0), "bias": F.round(F.when(fine, F.regr_intercept("heading_deg", "value")).otherwise(F.avg(_c("heading_deg") + _c("value"))), 4)}


@_per_trip("a22_wheel_radius", f"select trip_key, {R('case when count(case when k > 10 then 1 end) > 20 then median(case when k > 10 then speed / (k * 0.9::double) end) else 0.30::double end')} as r from sig group by trip_key")
def a22(d):
    v = F.when(_c("k") > 10, _c("speed") / (_c("k") * 0.9))
    return d, {"r": F.when(F.count(v) > 20, F.median(v)).otherwise(0.30)}


@query("a23_circular_mean", f", p as (select trip_key, quantile_cont(abs(acc_x), 0.8) as p from sig group by trip_key) select s.trip_key, {R('atan2(avg(sin(radians(heading_deg) - acc_y)), avg(cos(radians(heading_deg) - acc_y)))')} as yaw from sig s join p on p.trip_key = s.trip_key where abs(acc_x) > p.p group by s.trip_key")
def a23(spark, sf_dir):
    d = signals(spark, sf_dir)
    p = d.groupBy("trip_key").agg(F.percentile(F.abs("acc_x"), 0.8).alias("p"))
    a = F.radians("heading_deg") - _c("acc_y")
    return d.join(p, "trip_key").where(F.abs("acc_x") > _c("p")).groupBy("trip_key").agg(rounded(F.atan2(F.avg(F.sin(a)), F.avg(F.cos(a)))).alias("yaw"))


@query("a24_interval_histogram", f"{_DT}, b as (select quantile_cont(dt, 0.995) as hi from q where dt > 0), x as (select least(79, cast(floor(dt / hi * 80) as bigint)) as bin from q, b where dt > 0 and dt <= hi) select bin, count(*) as n from x group by bin")
def a24(spark, sf_dir):
    d = numbering.numbered(signals(spark, sf_dir).select(W.diff(_c("t")).alias("dt")).where("dt > 0"), ["dt"])
    hi = numbering.quantile(d, "dt", 0.995).withColumnRenamed("dt", "hi")  # one row
    x = d.crossJoin(hi).where("dt <= hi").select(F.least(F.lit(79).cast("long"), F.floor(_c("dt") / _c("hi") * 80)).alias("bin"))
    return x.groupBy("bin").agg(F.count("*").alias("n"))


@_per_trip("a25_static_bias", f"select trip_key, {R('avg(acc_x)')} as bx, {R('avg(acc_z) - 9.80665')} as bz, {R('avg(gyro_z)')} as gz from sig group by trip_key")
def a25(d):
    return d, {"bx": F.avg("acc_x"), "bz": F.avg("acc_z") - S.G, "gz": F.avg("gyro_z")}


@query("a26_static_tilt", f", f as (select *, row_number() over (partition by trip_key order by i) as n from sig where abs(gyro_z) < 0.3), m as (select trip_key, avg(acc_x) as x, avg(acc_y) as y, avg(acc_z) as z from f where n <= 50 group by trip_key) select trip_key, {R('asin(x / sqrt(x*x + y*y + z*z))')} as pitch, {R('asin(-y / sqrt(x*x + y*y + z*z))')} as roll from m")
def a26(spark, sf_dir):
    d = signals(spark, sf_dir).where(F.abs("gyro_z") < 0.3).withColumn("n", F.row_number().over(W.over())).where("n <= 50")
    m = d.groupBy("trip_key").agg(*[F.avg(f"acc_{a}").alias(a) for a in "xyz"])
    g = F.sqrt(_c("x") ** 2 + _c("y") ** 2 + _c("z") ** 2)
    return m.select("trip_key", rounded(F.asin(_c("x") / g)).alias("pitch"), rounded(F.asin(-_c("y") / g)).alias("roll"))


@query("a27_dynamic_yaw", f", f as (select *, row_number() over (partition by trip_key order by i) as n from sig where speed >= 3) select trip_key, {R('median(' + _PMOD('heading_deg - value + 180', '360.0::double') + ' - 180)')} as yaw from f where n <= 60 group by trip_key")
def a27(spark, sf_dir):
    d = signals(spark, sf_dir).where("speed >= 3").withColumn("n", F.row_number().over(W.over())).where("n <= 60")
    return d.groupBy("trip_key").agg(rounded(F.median(S.wrap_deg(_c("heading_deg") - _c("value")))).alias("yaw"))


@_per_trip("a29_sample_rate", f"{_DT}select trip_key, {R('1 / median(case when dt > 0 then dt end)', 4)} as hz from q group by trip_key", 4)
def a29(d):
    d = d.withColumn("dt", W.diff(_c("t")))
    return d, {"hz": 1 / F.median(F.when(_c("dt") > 0, _c("dt")))}

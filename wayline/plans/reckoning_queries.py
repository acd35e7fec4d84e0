"""Queries of outages and dead reckoning."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import series as W
from ..operators import deadreckon as D
from ..operators import outage
from ..operators.rounds import written
from ..sources.signals import GAP_S, signals
from ..sources.signals import SQL as S_SQL
from .registry import query, rounded
from .series_queries import _ENU0, _HAV, OVER, STEP, UPTO, R, _enu

_c = F.col


def vehicle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signal view with the vehicle's and phone's other channels."""
    return _enu(signals(spark, sf_dir)).withColumns({
        "gps_speed": _c("speed") * 1.01, "ind_speed_kmh": F.when(_c("k") % 9 != 0, _c("speed") * 3.6 * 1.02), "wheel": _c("speed") / 0.31,
        "yaw_rate_dps": F.degrees("gyro_z") + 0.5, "gyro_dps": F.degrees("gyro_z"), "gyro_x": _c("gyro_z") * 0.1, "gyro_y": _c("gyro_z") * 0.2,
        "grav_x": _c("acc_x") * 0.01, "grav_y": _c("acc_y") * 0.01, "grav_z": _c("acc_z"),
    })


def fixed(rows: DataFrame, **more) -> DataFrame:
    return outage.fixed_outages(rows, warmup_s=15.0, duration_s=30.0, max_gap_s=GAP_S, **more)


_FIX = f""", gp as (select *, case when t - lag(t) {OVER} > 5 then 1 else 0 end as gap from en),
wi as (select trip_key, min(case when t >= 15 then i end) as i0, coalesce(min(case when t >= 45 then i end), count(*)) as i1, count(*) as n from gp group by trip_key),
win as (select w.trip_key, w.i0, w.i1 from wi w join gp g on g.trip_key = w.trip_key and g.i >= w.i0 and g.i < w.i1 where w.i0 < w.n - 2 and w.i1 > w.i0 + 1
 group by w.trip_key, w.i0, w.i1 having sum(case when g.i > w.i0 then g.gap else 0 end) = 0 and sum(case when g.speed > 3 then 1 else 0 end) >= 0.5 * (w.i1 - w.i0))
"""


@query("d01_fixed_outages", f"{_ENU0}{_FIX}select trip_key, i0, i1 from win")
def d01(spark, sf_dir):
    return fixed(signals(spark, sf_dir)).select("trip_key", "i0", "i1")


@query("j07_outage_mask", f"{_ENU0}{_FIX}select s.trip_key, s.i, cast(case when s.i >= w.i0 and s.i < w.i1 then 0 when s.gnss_valid then 1 else 0 end as tinyint) as gnss_available from sig s left join win w on w.trip_key = s.trip_key")
def j07(spark, sf_dir):
    d = signals(spark, sf_dir)
    return outage.apply_mask(d, fixed(d)).select("trip_key", "i", "gnss_available")


query("d05_outage_mask_array", f"{_ENU0}{_FIX}select w.trip_key, s.i from win w join sig s on s.trip_key = w.trip_key where s.i >= w.i0 and s.i < w.i1")(lambda s, d: (lambda x: outage.apply_mask(x.withColumn("gnss_valid", F.lit(True)), fixed(x)).where("gnss_available = 0").select("trip_key", "i"))(signals(s, d)))


@query("j08_scoring_slice", f"{_ENU0}{_FIX}select s.trip_key, s.i, {R('s.speed')} as speed from win w join sig s on s.trip_key = w.trip_key where s.i >= w.i0 - 1 and s.i < w.i1")
def j08(spark, sf_dir):
    d = vehicle(spark, sf_dir)
    a = D.anchors(d, fixed(d))
    return d.join(a, "trip_key").where("i >= a and i < i1").select("trip_key", "i", rounded(_c("speed")).alias("speed"))


# The pairs that need no calibration, and the SQL of their speed and course.
_SPEED = {"truth": "speed", "hold": "v0", "gps_decay": "v0 * exp(-(t - ta) / 30.0::double)", "obd": "coalesce(case when k % 9 <> 0 then speed * 3.6::double * 1.02::double end / 3.6::double, v0)"}
_HEAD = {"truth": "heading_deg", "gps_hold": "course0"}
PLAIN = (("truth", "truth"), ("hold", "truth"), ("obd", "gps_hold"), ("hold", "gps_hold"), ("gps_decay", "gps_hold"))
_TRACK = f"""{_ENU0}{_FIX}, an as (select w.trip_key, w.i0, w.i1, s.speed * 1.01::double as v00, s.speed as sp0, s.heading_deg as course0, s.e as e0, s.n as n0, s.t as ta from win w join en s on s.trip_key = w.trip_key and s.i = w.i0 - 1),
sl as (select s.*, case when v00 > 0 then v00 else sp0 end as v0, course0, e0, n0, ta from an a join en s on s.trip_key = a.trip_key and s.i >= a.i0 - 1 and s.i < a.i1),
lo as ({" union all ".join(f"select trip_key, i, t, e, n, e0, n0, speed, '{a}' as speed_source, '{b}' as heading_source, greatest(0.0::double, least({_SPEED[a]}, 90.0::double)) as v, radians({_HEAD[b]}) as c from sl" for a, b in PLAIN)}),
dv as (select *, v * sin(c) as ve, v * cos(c) as vn, t - lag(t) over q as dt, e - lag(e) over q as de, n - lag(n) over q as dn from lo window q as (partition by trip_key, speed_source, heading_source order by i)),
st2 as (select *, (ve + lag(ve) over q) * 0.5::double * dt as se, (vn + lag(vn) over q) * 0.5::double * dt as sn from dv window q as (partition by trip_key, speed_source, heading_source order by i)),
po as (select *, e0 + sum(coalesce(se, 0)) over q as ee, n0 + sum(coalesce(sn, 0)) over q as nn, sum(coalesce(sqrt(de * de + dn * dn), 0)) over q as path from st2 window q as (partition by trip_key, speed_source, heading_source order by i rows between unbounded preceding and current row)),
tr as (select *, sqrt(pow(ee - e, 2) + pow(nn - n, 2)) as err from po),
me as (select trip_key, speed_source, heading_source, arg_max(err, i) as final_m, max(err) as max_m, sqrt(avg(err * err)) as rmse_m, arg_max(path, i) as path_m from tr group by trip_key, speed_source, heading_source)
"""


def plain_tracks(spark, sf_dir):
    d = vehicle(spark, sf_dir)
    return D.dead_reckon(D.with_sources(d, fixed(d), PLAIN), PLAIN)


def plain_metrics(spark, sf_dir):
    return D.drift_metrics(plain_tracks(spark, sf_dir))


@query("d06_dead_reckon", f"{_TRACK}select trip_key, i, speed_source, heading_source, {R('ee', 3)} as e_est, {R('nn', 3)} as n_est from tr")
def d06(spark, sf_dir):
    return plain_tracks(spark, sf_dir).select("trip_key", "i", "speed_source", "heading_source", rounded(_c("e_est"), 3).alias("e_est"), rounded(_c("n_est"), 3).alias("n_est"))


def _source(name, kind, source):
    pair = next(p for p in PLAIN if p[0 if kind == "speed" else 1] == source)

    @query(name, f"{_TRACK}select trip_key, i, {R('v' if kind == 'speed' else 'degrees(c)')} as x from tr where speed_source = '{pair[0]}' and heading_source = '{pair[1]}'")
    def run(spark, sf_dir):
        d = vehicle(spark, sf_dir)
        return D.with_sources(d, fixed(d), [pair]).select("trip_key", "i", rounded(_c(f"{'v' if kind == 'speed' else 'h'}_{source}")).alias("x"))


for _n, _k, _s in (("d07_speed_truth", "speed", "truth"), ("d08_speed_hold", "speed", "hold"), ("d09_speed_gps_decay", "speed", "gps_decay"), ("d11_speed_obd", "speed", "obd"), ("d13_heading_truth", "heading", "truth"), ("d14_heading_gps_hold", "heading", "gps_hold")):
    _source(_n, _k, _s)
#: Rows that an alignment needs here, where trips have few before an outage.
LEAST = 5
_LEVEL = "case when ax2 < 0 then -1.0::double else 1.0::double end * sqrt(ax2 * ax2 + ay2 * ay2)"


def _run_sql(win: str, combos, keep: str) -> str:
    """SQL of dead reckoning: `win` ends with a table win(trip_key, w, i0, i1); `keep` is the final select. Tables: cy, cg, al, wr
    (calibrations), so (rows with every source), lo to me (tracks and their scores)."""
    wrap = lambda x: f"((({x}) + 180) % 360 + 360) % 360 - 180"
    pairs = " union all ".join(f"select trip_key, w, i, t, e, n, e0, n0, speed, '{a}' as speed_source, '{b}' as heading_source, v_{a} as v, radians(h_{b}) as c from so" for a, b in combos)
    lead = lambda sec: f"select a.w, s.* from an a join ve s on s.trip_key = a.trip_key and s.i < a.i0 and s.t >= a.ta - {sec}"
    k, q = "trip_key, w", "partition by trip_key, w order by i"
    q4, up = "partition by trip_key, w, speed_source, heading_source order by i", "rows between unbounded preceding and current row"
    limit = lambda x: f"greatest(0.0::double, least({x}, 90.0::double))"
    turned = lambda x: f"course0 + sum(coalesce({x}, 0) * dt) over ({q} {up})"
    return f"""{win}, ve as (select *, speed * 1.01::double as gps_speed, case when k % 9 <> 0 then speed * 3.6::double * 1.02::double end as ind, speed / 0.31::double as wheel, degrees(gyro_z) + 0.5::double as yr, degrees(gyro_z) as gd, gyro_z * 0.1::double as gyx, gyro_z * 0.2::double as gyy, acc_x * 0.01::double as grx, acc_y * 0.01::double as gry from en),
an as (select win.trip_key, win.w, win.i0, win.i1, case when s.gps_speed > 0 then s.gps_speed else s.speed end as v0, s.heading_deg as course0, s.e as e0, s.n as n0, s.t as ta from win join ve s on s.trip_key = win.trip_key and s.i = win.i0 - 1),
l3 as (select *, ({wrap('heading_deg - lag(heading_deg) over q')}) / (t - lag(t) over q) as tr, t - lag(t) over q as dt from ({lead(300)}) x window q as ({q})),
yb as (select {k}, case when sum(case when abs(tr) < 1 then 1 else 0 end) > 20 then median(case when abs(tr) < 1 then yr end) else median(yr) end as bias from l3 where tr is not null group by {k}),
ya as (select l3.trip_key, l3.w, bias, sum(case when abs(tr) > 3 then 1 else 0 end) as turns, sum(case when abs(tr) > 3 then tr * dt end) as net, sum(case when abs(tr) > 3 then (yr - bias) * dt end) as own, sum(case when abs(tr) > 3 then tr * (yr - bias) end) as xy, sum(case when abs(tr) > 3 then pow(yr - bias, 2) end) as xx from l3 join yb on yb.trip_key = l3.trip_key and yb.w = l3.w where tr is not null group by l3.trip_key, l3.w, bias),
ys as (select *, case when abs(own) > 20 then net / own else xy / case when xx > 0 then xx end end as s from ya),
cy as (select {k}, case when coalesce(turns > 30 and abs(s) between 0.2 and 5, false) then s else 1.0::double end as scale, bias from ys),
l1 as (select *, ({wrap('heading_deg - lag(heading_deg) over q')}) / (t - lag(t) over q) as tr from ({lead(60)}) x window q as ({q})),
ga as (select {k}, count(*) as cnt, stddev_pop(tr) as sd, regr_slope(tr, gd) as s, regr_intercept(tr, gd) as b, avg(tr + gd) as m from l1 where tr is not null group by {k}),
cg as (select {k}, case when coalesce(cnt >= 20 and sd > 1.5 and abs(s) between 0.2 and 5 and s < 0, false) then s else -1.0::double end as scale, case when coalesce(cnt >= 20 and sd > 1.5 and abs(s) between 0.2 and 5 and s < 0, false) then b when cnt >= 20 then m else 0.0::double end as bias from ga),
gm as (select {k}, avg(grx) as mx, avg(gry) as my, avg(acc_z) as mz from l1 group by {k}),
gn as (select {k}, mx / sqrt(mx * mx + my * my + mz * mz) as gx, my / sqrt(mx * mx + my * my + mz * mz) as gy, mz / sqrt(mx * mx + my * my + mz * mz) as gz from gm),
pz as (select l1.*, gx, gy, gz, degrees(gx * gyx + gy * gyy + gz * gyro_z) as z from l1 join gn on gn.trip_key = l1.trip_key and gn.w = l1.w),
pa as (select {k}, gx, gy, gz, count(*) as cnt, stddev_pop(tr) as s1, stddev_pop(z) as s2, regr_slope(tr, z) as s, regr_intercept(tr, z) as b, avg(tr + z) as m, corr(tr, z) as r from pz where abs(tr) < 60 and speed > 2 group by {k}, gx, gy, gz),
al as (select {k}, gx, gy, gz, case when coalesce(s1 > 1 and s2 > 1 and abs(s) > 0.3 and abs(s) < 3, false) then s else -1.0::double end as scale, case when coalesce(s1 > 1 and s2 > 1 and abs(s) > 0.3 and abs(s) < 3, false) then b else m end as bias, case when isnan(r) then 0.0::double else coalesce(r, 0.0::double) end as quality from pa where cnt >= {LEAST}),
wr as (select {k}, case when count(case when wheel > 1 and speed > 1 then 1 end) > 20 then median(case when wheel > 1 and speed > 1 then speed / wheel end) else 0.3::double end as radius from l3 group by {k}),
s0 as (select s.*, a.w, a.v0, a.course0, a.e0, a.n0, a.ta, coalesce(s.t - lag(s.t) over (partition by a.trip_key, a.w order by s.i), 0) as dt, acc_x * cos(pitch) + (acc_y * sin(roll) + acc_z * cos(roll)) * sin(pitch) as ax2, acc_y * cos(roll) - acc_z * sin(roll) as ay2 from an a join ve s on s.trip_key = a.trip_key and s.i >= a.i0 - 1 and s.i < a.i1),
s1 as (select s0.*, cy.scale as ysc, cy.bias as ybi, cg.scale as gsc, cg.bias as gbi, al.scale as psc, al.bias as pbi, al.quality, gx, gy, gz, radius, sum({_LEVEL} * dt) over (partition by s0.trip_key, s0.w order by i {up}) as sm from s0 left join cy on cy.trip_key = s0.trip_key and cy.w = s0.w left join cg on cg.trip_key = s0.trip_key and cg.w = s0.w left join al on al.trip_key = s0.trip_key and al.w = s0.w left join wr on wr.trip_key = s0.trip_key and wr.w = s0.w),
so as (select *, {limit('speed')} as v_truth, {limit('v0')} as v_hold, {limit('v0 * exp(-(t - ta) / 30.0::double)')} as v_gps_decay, {limit(f'sm + greatest(v0, -min(sm) over ({q} {up}))')} as v_imu_integrate, {limit('coalesce(ind / 3.6::double, v0)')} as v_obd, {limit('radius * wheel')} as v_wheel_speed,
 heading_deg as h_truth, course0 as h_gps_hold, {turned('ysc * yr + ybi')} as h_veh_yawrate, {turned('gsc * gd + gbi')} as h_gyro, {turned('case when abs(quality) >= 0.4 then psc * degrees(gx * gyx + gy * gyy + gz * gyro_z) + pbi end')} as h_imu_aligned from s1),
lo as ({pairs}),
dv as (select *, v * sin(c) as vex, v * cos(c) as vnx, t - lag(t) over q as dt, e - lag(e) over q as de, n - lag(n) over q as dn from lo window q as ({q4})),
st2 as (select *, (vex + lag(vex) over q) * 0.5::double * dt as se, (vnx + lag(vnx) over q) * 0.5::double * dt as sn from dv window q as ({q4})),
po as (select *, e0 + sum(coalesce(se, 0)) over q as ee, n0 + sum(coalesce(sn, 0)) over q as nn, sum(coalesce(sqrt(de * de + dn * dn), 0)) over q as path from st2 window q as ({q4} {up})),
tr as (select *, sqrt(pow(ee - e, 2) + pow(nn - n, 2)) as err from po),
me as (select trip_key, w, speed_source, heading_source, arg_max(err, i) as final_m, arg_max(path, i) as path_m from tr group by trip_key, w, speed_source, heading_source)
{keep}"""


_WIN0 = f"{_ENU0}{_FIX.replace('win as (select w.trip_key, w.i0, w.i1', 'win as (select w.trip_key, 0 as w, w.i0, w.i1')}"
for _n, _x, _pair in (("d10_speed_imu_integrate", "v_imu_integrate", ("imu_integrate", "truth")), ("d12_speed_wheel", "v_wheel_speed", ("wheel_speed", "truth")), ("d15_heading_yaw_rate", "h_veh_yawrate", ("truth", "veh_yawrate")), ("d16_heading_gyro", "h_gyro", ("truth", "gyro")), ("d17_heading_imu_aligned", "h_imu_aligned", ("truth", "imu_aligned"))):
    query(_n, _run_sql(_WIN0, [_pair], f"select trip_key, i, {R(_x, 4)} as x from so"))(lambda s, d, x=_x, pair=_pair: (lambda v: D.with_sources(v, fixed(v), [pair], least=LEAST).select("trip_key", "i", rounded(_c(x), 4).alias("x")))(vehicle(s, d)))


def _fit(name: str, table: str, columns: tuple[str, ...], fit) -> None:
    @query(name, _run_sql(_WIN0, PLAIN, f"select trip_key, {', '.join(f'{R(c, 5)} as {c}' for c in columns)} from {table}"))
    def run(spark, sf_dir):
        v = vehicle(spark, sf_dir)
        return fit(v, D.anchors(v, fixed(v))).select("trip_key", *[rounded(_c(c), 5).alias(c) for c in columns])


_fit("d18_alignment_estimate", "al", ("gx", "gy", "gz", "scale", "bias", "quality"), lambda v, a: D.align_phone(v, a, least=LEAST))
_fit("a20_gyro_calibration", "cg", ("scale", "bias"), D.calibrate_gyro)
_fit("a21_rate_calibration", "cy", ("scale", "bias"), D.calibrate_rate)
query("d19_alignment_window", f"{_ENU0}{_FIX}, an as (select w.trip_key, w.i0, s.t as ta from win w join en s on s.trip_key = w.trip_key and s.i = w.i0 - 1) select s.trip_key, s.i from an a join sig s on s.trip_key = a.trip_key and s.i < a.i0 and s.t >= a.ta - 60")(lambda s, d: (lambda v: D.lead_in(v, D.anchors(v, fixed(v)), 60.0).select("trip_key", "i"))(vehicle(s, d)))


@query("a09_drift_metrics", f"{_TRACK}select trip_key, speed_source, heading_source, {R('final_m', 3)} as final_m, {R('max_m', 3)} as max_m, {R('rmse_m', 3)} as rmse_m, {R('path_m', 3)} as path_m, {R('final_m * 100 / greatest(path_m, 1e-6::double)', 3)} as drift_pct, final_m * 100 / greatest(path_m, 1e-6::double) <= 10 as passed from me")
def a09(spark, sf_dir):
    return plain_metrics(spark, sf_dir).select("trip_key", "speed_source", "heading_source", *[rounded(_c(x), 3).alias(x) for x in ("final_m", "max_m", "rmse_m", "path_m", "drift_pct")], "passed")


_MAE = f"{_TRACK}, g as (select *, lag(e) over q as f0, lead(e) over q as f1, lag(n) over q as g0, lead(n) over q as g1, t - lag(t) over q as a, lead(t) over q - t as b from tr window q as (partition by trip_key, speed_source, heading_source order by i)), gv as (select *, case when f0 is null then (f1 - e) / b when f1 is null then (e - f0) / a else (a*a*f1 + (b*b - a*a)*e - b*b*f0) / (a*b*(a+b)) end as gx, case when g0 is null then (g1 - n) / b when g1 is null then (n - g0) / a else (a*a*g1 + (b*b - a*a)*n - b*b*g0) / (a*b*(a+b)) end as gy from g)\n"


@query("a10_speed_mae", f"{_MAE}select trip_key, speed_source, heading_source, {R('case when speed_source <> ' + chr(39) + 'truth' + chr(39) + ' then avg(abs(v - sqrt(gx*gx + gy*gy))) end', 3)} as mae from gv group by trip_key, speed_source, heading_source")
def a10(spark, sf_dir):
    return plain_metrics(spark, sf_dir).select("trip_key", "speed_source", "heading_source", rounded(_c("speed_mae"), 3).alias("mae"))


_SUM = f"{_TRACK}select {{keys}}count(*) as n, {R('avg(case when final_m * 100 / greatest(path_m, 1e-6::double) <= 10 then 1.0::double else 0.0::double end)')} as pass_rate, {R('median(final_m * 100 / greatest(path_m, 1e-6::double))', 3)} as median_pct, {R('quantile_cont(final_m * 100 / greatest(path_m, 1e-6::double), 0.9)', 3)} as p90_pct from me{{group}}"


@query("a11_benchmark_aggregate", _SUM.format(keys="", group=""))
def a11(spark, sf_dir):
    m = plain_metrics(spark, sf_dir)
    return m.agg(F.count("*").alias("n"), rounded(F.avg(_c("passed").cast("double"))).alias("pass_rate"), rounded(F.median("drift_pct"), 3).alias("median_pct"), rounded(F.percentile("drift_pct", 0.9), 3).alias("p90_pct"))


def flagship(spark, sf_dir):
    s = D.summarise(plain_metrics(spark, sf_dir))
    return s.select("speed_source", "heading_source", "n", rounded(_c("pass_rate")).alias("pass_rate"), rounded(_c("median_pct"), 3).alias("median_pct"), rounded(_c("p90_pct"), 3).alias("p90_pct"))


query("a12_combo_summary", _SUM.format(keys="speed_source, heading_source, ", group=" group by speed_source, heading_source"))(flagship)


@query("a06_truth_consistency", f"{_TRACK}select trip_key, {R('final_m * 100 / greatest(path_m, 1e-6::double)', 3)} as pct, final_m * 100 / greatest(path_m, 1e-6::double) < 3 as consistent from me where speed_source = 'truth' and heading_source = 'truth'")
def a06(spark, sf_dir):
    m = plain_metrics(spark, sf_dir).where("speed_source = 'truth' and heading_source = 'truth'")
    return m.select("trip_key", rounded(_c("drift_pct"), 3).alias("pct"), (_c("drift_pct") < 3).alias("consistent"))


@query("d20_nhc_reckoner", f", l as (select *, lag(radians(heading_deg)) {OVER} as h0, radians(heading_deg) as h1, lag(speed) {OVER} as s0, t - lag(t) {OVER} as dt from sig), a as (select *, h0 + ((((h1 - h0) + pi()) % (2 * pi()) + 2 * pi()) % (2 * pi()) - pi()) * 0.5::double as av, (s0 + speed) * 0.5::double * dt as ds from l) select trip_key, i, {R(f'sum(coalesce(ds * sin(av), 0)) {UPTO}', 3)} as east, {R(f'sum(coalesce(ds * cos(av), 0)) {UPTO}', 3)} as north, {R(f'(t - first_value(t) {UPTO}) * 0.8')} as std_m from a")
def d20(spark, sf_dir):
    d = D.nhc_dead_reckoner(signals(spark, sf_dir))
    return d.select("trip_key", "i", rounded(_c("east"), 3).alias("east"), rounded(_c("north"), 3).alias("north"), rounded(_c("std_m")).alias("std_m"))


_PRESETS = ", ".join(f"('{k}', {'null' if s.duration_s is None else s.duration_s}::double, {'null' if s.length_m is None else s.length_m}::double, {s.max_windows})" for k, s in outage.SCENARIOS.items())


@query("d03_scenarios", f"{STEP}, le as (select trip_key, max(t) - min(t) as d, sum(coalesce(step, 0)) as m from st group by trip_key) select trip_key, name, duration_s, length_m, max_windows, coalesce(d >= duration_s, false) or coalesce(m >= length_m, false) as long_enough from le cross join (values {_PRESETS}) v(name, duration_s, length_m, max_windows)")
def d03(spark, sf_dir):
    """The presets for each trip, and whether it is as long as their outage."""
    d = signals(spark, sf_dir).withColumn("step", F.coalesce(W.step_m(_c("lat"), _c("lon")), F.lit(0.0))).groupBy("trip_key").agg((F.max("t") - F.min("t")).alias("d"), F.sum("step").alias("m"))
    preset = lambda k, s: F.struct(F.lit(k).alias("name"), F.lit(s.duration_s).cast("double").alias("duration_s"), F.lit(s.length_m).cast("double").alias("length_m"), F.lit(s.max_windows).alias("max_windows"))
    d = d.withColumn("s", F.explode(F.array(*[preset(k, s) for k, s in outage.SCENARIOS.items()]))).select("trip_key", "d", "m", "s.*")
    fits = F.coalesce(_c("d") >= _c("duration_s"), F.lit(False)) | F.coalesce(_c("m") >= _c("length_m"), F.lit(False))
    return d.select("trip_key", "name", "duration_s", "length_m", "max_windows", fits.alias("long_enough"))


TUNNELS = outage.Spec(10.0, warmup_s=10.0, cooldown_s=2.0, min_gap_s=8.0, max_windows=3, lead_s=8.0, max_step_s=GAP_S)


def _candidate_sql(spec: outage.Spec) -> str:
    """SQL of the candidates of a spec with a duration: a table ca with the columns of outage.candidates()."""
    return f"""{_ENU0}, x1 as (select *, lag(t) {OVER} as pt, lag(lat) {OVER} as plat, lag(lon) {OVER} as plon from en),
x2 as (select *, case when t - pt > {spec.max_step_s} then 1 else 0 end as gap, sum(coalesce({_HAV}, 0)) {UPTO} as dist from x1),
en1 as (select trip_key, max(t) as tend from x2 group by trip_key),
cs as (select trip_key, c, {spec.warmup_s}::double + c * {spec.step}::double as s from en1, lateral (select unnest(range(0, greatest(cast(ceil((greatest({spec.warmup_s + spec.step}::double, tend - {spec.cooldown_s}::double) - {spec.warmup_s}::double) / {spec.step}::double) as bigint) - 1, 0) + 1)) as c) u),
p0 as (select cs.trip_key, c, min(x.i) as i0 from cs join x2 x on x.trip_key = cs.trip_key and x.t >= s group by cs.trip_key, c),
p1 as (select p0.*, x.t as t0, x.speed as sp0, x.dist as d0 from p0 join x2 x on x.trip_key = p0.trip_key and x.i = p0.i0),
p2 as (select p1.trip_key, c, i0, t0, sp0, d0, min(case when x.t >= t0 + {spec.duration_s}::double then x.i end) as i1, min(case when x.t >= t0 - {spec.lead_s}::double then x.i end) as il from p1 join x2 x on x.trip_key = p1.trip_key group by p1.trip_key, c, i0, t0, sp0, d0),
p3 as (select p2.trip_key, c, i0, t0, sp0, d0, i1, il, max(case when x.i < i1 then x.t end) as t1, max(case when x.i = i1 - 1 then x.dist end) - d0 as span_m, sum(case when x.i > il and x.i < i1 then gap else 0 end) as gaps,
 sum(case when x.i >= i0 and x.i < i1 and speed > {spec.moving} then 1 else 0 end) as inside, sum(case when x.i >= il and x.i < i0 and speed > {spec.moving} then 1 else 0 end) as lm, sum(case when x.i >= il and x.i < i0 and speed is not null then 1 else 0 end) as lv from p2 join x2 x on x.trip_key = p2.trip_key where i1 > i0 group by p2.trip_key, c, i0, t0, sp0, d0, i1, il),
ca as (select *, coalesce(sp0 >= {spec.min_speed} and i0 - il >= 5 and lm > 0.8 * (i0 - il) and lv > 0.9 * (i0 - il) and gaps = 0 and inside >= {spec.min_moving} * (i1 - i0) and t1 - t0 >= {spec.duration_s / 2}::double, false) as ok from p3)
"""


def _greedy_sql(spec: outage.Spec) -> str:
    """The accepted ones of these in order: a table win(trip_key, w, i0, i1, t0, t1, span_m)."""
    return f"""{_candidate_sql(spec)}, oks as (select *, row_number() over (partition by trip_key order by c) as rk from ca where ok),
gr as (select trip_key, rk, true as taken, 1 as got, t1 as last from oks where rk = 1
 union all select o.trip_key, o.rk, o.t0 >= g.last + {spec.min_gap_s} and g.got < {spec.max_windows}, g.got + case when o.t0 >= g.last + {spec.min_gap_s} and g.got < {spec.max_windows} then 1 else 0 end, case when o.t0 >= g.last + {spec.min_gap_s} and g.got < {spec.max_windows} then o.t1 else g.last end from gr g join oks o on o.trip_key = g.trip_key and o.rk = g.rk + 1),
win as (select o.trip_key, cast(g.got - 1 as integer) as w, i0, i1, t0, t1, span_m from gr g join oks o on o.trip_key = g.trip_key and o.rk = g.rk where taken)
"""


def _recursive(sql: str) -> str:
    return (S_SQL + sql).replace("with ", "with recursive ", 1)


def _shown(spec: outage.Spec):
    def run(spark, sf_dir):
        d = outage.outages(signals(spark, sf_dir), spec)
        return d.select("trip_key", "window", "i0", "i1", *[rounded(_c(x), 3).alias(x) for x in ("t0", "t1", "span_m")])

    return run


_GREEDY = f"select trip_key, w as \"window\", i0, i1, {R('t0', 3)} as t0, {R('t1', 3)} as t1, {R('span_m', 3)} as span_m from win"
query("d02_greedy_outages", _recursive(_greedy_sql(TUNNELS) + _GREEDY))(_shown(TUNNELS))
query("d04_first_window", _recursive(_greedy_sql(replace(TUNNELS, max_windows=1)) + _GREEDY))(_shown(replace(TUNNELS, max_windows=1)))
query("t06_max_windows", _recursive(_greedy_sql(replace(TUNNELS, max_windows=2)) + "select trip_key, count(*) as n from win group by trip_key"))(lambda s, d: outage.outages(signals(s, d), replace(TUNNELS, max_windows=2)).groupBy("trip_key").agg(F.count("*").alias("n")))


@query("f09_anchor_predicate", _candidate_sql(TUNNELS) + "select trip_key, c, i0, i1, ok from ca")
def f09(spark, sf_dir):
    return outage.candidates(signals(spark, sf_dir), TUNNELS).select("trip_key", "c", "i0", "i1", "ok")


def full_metrics(spark, sf_dir):
    d = vehicle(spark, sf_dir)
    found = written(outage.outages(d, TUNNELS), "outages")  # a few rows for each trip, read by several steps
    return D.drift_metrics(D.dead_reckon(D.with_sources(d, found, least=LEAST)))


_DRIFT = "final_m * 100 / greatest(path_m, 1e-6::double)"


@query("d21_benchmark_run", _recursive(_run_sql(_greedy_sql(TUNNELS), D.COMBOS, f"select speed_source, heading_source, count(*) as n, {R(f'avg(case when {_DRIFT} <= 10 then 1.0::double else 0.0::double end)')} as pass_rate, {R(f'median({_DRIFT})', 3)} as median_pct, {R(f'quantile_cont({_DRIFT}, 0.9)', 3)} as p90_pct, {R('median(final_m)', 3)} as median_final_m from me group by speed_source, heading_source")))
def d21(spark, sf_dir):
    """All outages of a scenario, all eight combinations, summarised."""
    s = D.summarise(full_metrics(spark, sf_dir))
    return s.select("speed_source", "heading_source", "n", rounded(_c("pass_rate")).alias("pass_rate"), *[rounded(_c(x), 3).alias(x) for x in ("median_pct", "p90_pct", "median_final_m")])


@query("j15_trip_scenario_combos", "select t.trip_key, s.name, c.speed_source, c.heading_source from (select distinct user_id as trip_key from events) t cross join (values ('isro_60s'), ('isro_1km'), ('short_30s'), ('tunnels'), ('every_2min')) s(name) cross join (values ('truth','truth'), ('truth','veh_yawrate'), ('hold','truth'), ('obd','veh_yawrate'), ('wheel_speed','veh_yawrate'), ('obd','gps_hold'), ('hold','imu_aligned'), ('imu_integrate','imu_aligned')) c(speed_source, heading_source)")
def j15(spark, sf_dir):
    trips = spark.read.parquet(f"{sf_dir}/events.parquet").select(_c("user_id").alias("trip_key")).distinct()
    runs = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("speed_source"), F.lit(b).alias("heading_source")) for n in outage.SCENARIOS for a, b in D.COMBOS])
    return trips.select("trip_key", F.explode(runs).alias("r")).select("trip_key", "r.*")

"""Queries of the fusion step's parts: each act of the filter alone on every row, and the state of sessions."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import deadreckon, graph
from ..sources.graphs import read_segments, shared_folder, write_graph
from ..sources.signals import signals
from ..streaming import fusion, ordered
from .other_queries import _GRAPH, _SNAP, fusion_rows, road
from .reckoning_queries import _WIN0, _run_sql, fixed, vehicle
from .registry import query, rounded
from .series_queries import OVER, UPTO, R

_c = F.col
_OUT = "trip_key long, i int, ve double, vn double, heading double, pos_std double, done boolean"


def _alone(name: str, act, sql: str, **options):
    """On each row: a filter started at the row's own fix, then one act on it; all rows of a batch at once."""

    def run(spark, sf_dir):
        def step(batches):
            for pdf in batches:
                at, e = np.arange(len(pdf)), fusion.Ekf(len(pdf), **options)
                r = {c: pdf[c].to_numpy(float) for c in pdf.columns if c not in ("trip_key", "i")}
                e.init(at, r["lat"], r["lon"], np.radians(r["heading_deg"]), r["speed"], np.full(len(at), 5.0))
                done = act(e, at, r)
                yield pd.DataFrame({"trip_key": pdf["trip_key"], "i": pdf["i"], "ve": e.x[:, 2], "vn": e.x[:, 3], "heading": np.degrees(e.x[:, 4]), "pos_std": e.pos_std(at), "done": True if done is None else done})

        d = signals(spark, sf_dir).select("trip_key", "i", "lat", "lon", "heading_deg", "speed", "gyro_z", "acc_x", "k")
        d = d.mapInPandas(step, _OUT)
        # Half a turn may come out with either sign.
        return d.select("trip_key", "i", *[rounded(_c(x), 5).alias(x) for x in ("ve", "vn", "pos_std")], rounded(F.abs("heading"), 5).alias("heading"), "done")

    query(name, sql)(run)


# The filter's start in SQL: velocity along the heading, position variance 64, velocity variances 1, heading's of 10 degrees.
_D = "radians(10::double)"
_W = lambda x: f"(((({x}) + pi()) % (2 * pi()) + 2 * pi()) % (2 * pi()) - pi())"
_START = f", f as (select trip_key, i, k, gyro_z, acc_x, heading_deg, speed as v, {_W('radians(heading_deg)')} as h from sig)\n"


def _shown(ve: str, vn: str, h: str, std: str = "8.0::double", done: str = "true", start: str = _START, table: str = "f") -> str:
    return f"{start}select trip_key, i, {R(ve, 5)} as ve, {R(vn, 5)} as vn, {R(std, 5)} as pos_std, {R(f'abs(degrees({h}))', 5)} as heading, {done} as done from {table}"


def _toward(target: str, std: str, gate: bool = False) -> str:
    """A heading measurement: the gain is the heading's variance over the sum of both, and the velocity turns with it."""
    start = f"{_START}, z as (select *, {_W(f'{target} - h')} as z from f), g as (select *, {f'z * z / (pow({_D}, 2) + pow({std}, 2)) <= 9' if gate else 'true'} as ok from z), n as (select *, case when ok then {_W(f'h + z * pow({_D}, 2) / (pow({_D}, 2) + pow({std}, 2))')} else h end as h2 from g)\n"
    return _shown("v * sin(h2)", "v * cos(h2)", "h2", done="ok", start=start, table="n")


def _faster(target: str, std: float) -> str:
    gain = f"(({target}) - v) / (1 + {std * std!r}::double)"
    return _shown(f"v * sin(h) + sin(h) * {gain}", f"v * cos(h) + cos(h) * {gain}", "h")


_ROAD_BEARING = "radians(round_even(heading_deg / 90, 0) * 90)"
_alone("x08_filter_init", lambda e, at, r: None, _shown("v * sin(h)", "v * cos(h)", "h"))
_NHC_S = f"(pow(cos(h), 2) * 1.05::double + pow(sin(h), 2) * 1.05::double + pow(v, 2) * (pow({_D}, 2) + 0.0005::double) + 0.01::double)"
_alone("x09_predict_nhc", lambda e, at, r: e.predict(at, 0.1), _shown("v * sin(h)", "v * cos(h)", "h", f"sqrt((2 * (64 + 0.01::double + 0.001::double) - (pow(0.1::double * cos(h), 2) + pow(0.1::double * sin(h), 2)) / {_NHC_S}) / 2)"))
_alone("x10_imu_heading", lambda e, at, r: e.heading(at, np.radians(r["heading_deg"] + r["gyro_z"] * 10), fusion.IMU_HEADING), _toward("radians(heading_deg + gyro_z * 10)", "radians(5::double)"))
_alone("x11_model_speed", lambda e, at, r: e.speed(at, r["speed"] + r["acc_x"], fusion.MODEL_SPEED), _faster("v + acc_x", 1.0))
_alone("x12_gnss_position", lambda e, at, r: e.position(at, r["k"] * 0.5, -r["k"] * 0.5, 4.0), _shown("v * sin(h)", "v * cos(h)", "h", "case when 0.5::double * k * k / 80 <= 25 then sqrt(64 * 16 / 80.0::double) else 8 end", "0.5::double * k * k / 80 <= 25"))
_alone("x13_gnss_heading", lambda e, at, r: e.heading(at, np.radians(r["heading_deg"] + r["k"]), fusion.GNSS_HEADING, gate=True), _toward("radians(heading_deg + k)", "radians(1.5::double)", gate=True))
_alone("x14_gnss_speed", lambda e, at, r: e.speed(at, r["speed"] * 1.1, fusion.GNSS_SPEED), _faster("v * 1.1::double", 0.3))
_alone("x15_road_bearing", lambda e, at, r: e.heading(at, np.radians(np.round(r["heading_deg"] / 90) * 90), fusion.ROAD), _toward(_ROAD_BEARING, "0.087::double"))
_alone("x16_zero_velocity", lambda e, at, r: e.zupt(at), _shown("v * sin(h) * 0.0025::double / 1.0025::double", "v * cos(h) * 0.0025::double / 1.0025::double", "h"))


def _broken(e, at, r) -> None:
    e.p[:] = np.nan
    e.repair(at)


_alone("x17_covariance_repair", _broken, _shown("v * sin(h)", "v * cos(h)", "h", "50.0::double"))
_alone("f10_position_gate", lambda e, at, r: e.position(at, r["k"] * 2.0, np.zeros(len(at)), 4.0), _shown("v * sin(h)", "v * cos(h)", "h", "case when 4.0::double * k * k / 80 <= 25 then sqrt(64 * 16 / 80.0::double) else 8 end", "4.0::double * k * k / 80 <= 25"))
_alone("f11_heading_gate", lambda e, at, r: e.heading(at, np.radians(r["heading_deg"] + r["k"] * 2), fusion.GNSS_HEADING, gate=True), _toward("radians(heading_deg + k * 2)", "radians(1.5::double)", gate=True))

# Fixes of their own rate and times, beside the samples.
_FIXES = "fx as (select trip_key, t + 0.37::double as t, lat, gnss_valid as valid from sig where k % 3 = 0)"


def _fixes(spark, sf_dir):
    return signals(spark, sf_dir).where(_c("k") % 3 == 0).select("trip_key", (_c("t") + 0.37).alias("t"), "lat", "lon", "speed", "heading_deg", _c("gnss_valid").alias("valid"))


@query("x03_gnss_side_input")
def x03(spark, sf_dir):
    """Sessions whose samples take the latest fix of another input."""
    rows, key = fusion_rows(spark, sf_dir), _c("trip_key").cast("string").alias("session")
    fixes = _fixes(spark, sf_dir).select(key, "t", "lat", "lon", "speed", "heading_deg", "valid")
    d = ordered.side_input(rows.drop("lat", "lon", "gnss_valid", "gnss_speed", "gnss_heading_deg"), fixes, "session")
    d = d.withColumnsRenamed({"fix_lat": "lat", "fix_lon": "lon", "fix_valid": "gnss_valid", "fix_speed": "gnss_speed", "fix_heading_deg": "gnss_heading_deg"})
    return fusion.fuse_batch(d).select("session", "t", "mode", "gnss_health")


@query("x03_latest_fix", f", {_FIXES}, un as (select trip_key, t, i, 1 as kind, null::double as ft, null::double as lat, null::boolean as valid from sig union all select trip_key, t, null, 0, t, lat, valid from fx), fi as (select *, last_value(case when kind = 0 then struct_pack(ft := ft, lat := lat, valid := valid) end ignore nulls) over (partition by trip_key order by t, kind, lat, valid rows between unbounded preceding and current row) as f from un) select trip_key, cast(i as integer) as i, {R('f.ft')} as fix_t, f.lat as fix_lat, f.valid as fix_valid from fi where kind = 1")
def x03_fix(spark, sf_dir):
    d = ordered.side_input(signals(spark, sf_dir).select("trip_key", "t", "i"), _fixes(spark, sf_dir).select("trip_key", "t", "lat", "valid"), "trip_key")
    return d.select("trip_key", "i", rounded(_c("fix_t")).alias("fix_t"), "fix_lat", "fix_valid")


_TICK = lambda t: f"cast(floor(({t} - t0) / 0.25::double) as bigint) + case when t0 + (floor(({t} - t0) / 0.25::double) + 1) * 0.25::double <= {t} then 1 when t0 + floor(({t} - t0) / 0.25::double) * 0.25::double > {t} then -1 else 0 end"


@query("x04_resampled_angles", f""", sa as (select trip_key, t, gyro_z as v, case when event_type <> 'error' then heading_deg end as h from sig),
un as (select *, min(t) over (partition by trip_key) as t0 from (select *, row_number() over (partition by trip_key, t order by v nulls first, h nulls first) as rk from sa) x where rk = 1),
le as (select *, lead(t) over w as b, lead(v) over w as vb, lead(h) over w as hb, t - lag(t) over w as own from un window w as (partition by trip_key order by t)),
tk as (select *, unnest(range(case when t = t0 then 0 else {_TICK('t')} + 1 end, {_TICK('b')} + 1)) as tick from le where b is not null),
al as (select *, (t0 + tick * 0.25::double - t) / (b - t) as al from tk)
select trip_key, cast(tick as integer) as tick, {R('t0 + tick * 0.25::double')} as t, {R('case when al > 0 then al * (b - t) else own end')} as dt_ref, {R('v + al * (vb - v)')} as gyro_z, {R('(((h + al * (((((hb - h + 180) % 360) + 360) % 360) - 180)) % 360) + 360) % 360', 4)} as heading_deg from al""")
def x04_angles(spark, sf_dir):
    """Ticks from each trip's first sample on; headings turn the short way, and are missing beside a missing one."""
    d = signals(spark, sf_dir).select("trip_key", "t", "gyro_z", F.when(_c("event_type") != "error", _c("heading_deg")).alias("heading_deg"))
    out = ordered.resample_from_first(d, 0.25, ["gyro_z"], ["heading_deg"])
    return out.select("trip_key", "tick", *[rounded(_c(c)).alias(c) for c in ("t", "dt_ref", "gyro_z")], rounded(_c("heading_deg"), 4).alias("heading_deg"))


# Debouncing in SQL: a run of 2 good or 5 bad fixes decides; outputs begin with the first fix that is used.
def _used(key: str = "trip_key", rows: str = "sig") -> str:
    over = f"over (partition by {key} order by i)"
    upto = f"over (partition by {key} order by i rows between unbounded preceding and current row)"
    return f""", ru as (select *, row_number() {over} as ord, sum(case when gnss_valid is distinct from pv then 1 else 0 end) {upto} as run from (select *, lag(gnss_valid) {over} as pv from {rows}) x),
de as (select *, row_number() over (partition by {key}, run order by i) as rs from ru),
us as (select *, gnss_valid and coalesce(last_value(case when gnss_valid and rs >= 2 then 1 when not gnss_valid and rs >= 5 then 0 end ignore nulls) {upto}, 1) = 1 as used from de),
st as (select {key}, min(i) as first from us where used group by {key})
"""


_USED = _used()


@query("x06_window_reset", f"""{_USED}, po as (select *, floor(t * 10)::bigint % 97 = 0 or least(abs(acc_z - 9.81::double), abs(acc_z + 9.81::double)) > 15 as pothole from us), gr as (select *, sum(case when pothole then 1 else 0 end) {UPTO} as g from po),
fi as (select *, row_number() over (partition by trip_key, g order by i) as nth from gr) select cast(trip_key as varchar) as session, {R('t')} as t, pothole, cast(least(60, nth) as integer) as window_fill from fi join st using (trip_key) where i >= first""")
def x06(spark, sf_dir):
    d = fusion_rows(spark, sf_dir).withColumn("acc_z", F.when(F.pmod(F.floor(_c("t") * 10), F.lit(97)) == 0, 40.0).otherwise(_c("acc_z")))
    return fusion.fuse_batch(d).select("session", rounded(_c("t")).alias("t"), "pothole", "window_fill")


@query("x07_aligner_phases", f"""{_USED}, dy as (select *, sum(case when used and ord >= 50 and value / 10.0::double >= 3 and k <> 0 then 1 else 0 end) {UPTO} as turns from us)
select cast(trip_key as varchar) as session, case when turns >= 60 then 'CALIBRATED' when ord >= 50 then 'STATIC_DONE' else 'UNCALIBRATED' end as phase, count(*) as n from dy join st using (trip_key) where i >= first group by all""")
def x07(spark, sf_dir):
    return fusion.fuse_batch(fusion_rows(spark, sf_dir).withColumn("gyro_z", F.lit(0.0))).groupBy("session", "phase").agg(F.count("*").alias("n"))


query("x19_reinit")(lambda s, d: fusion.fuse_batch(fusion_rows(s, d)).where("mode = 'GNSS_REACQUIRE'").select("session", "t", "pos_std"))
@query("x22_static_map_join", _SNAP)
def x22(spark, sf_dir):
    """A stream of points against the map as it is stored: each batch of the stream meets the whole of the static side."""
    nodes, edges, segments, points = road(spark, sf_dir)
    folder = f"{shared_folder(spark)}/wayline/map-{uuid.uuid4().hex}"
    write_graph(nodes, edges, segments, 52.0, -1.0, f"{folder}/graph")
    points.repartition(4).write.parquet(f"{folder}/points")
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/points")
    static = read_segments(spark, f"{folder}/graph", 52.0, -1.0)

    def matched(batch, number: int) -> None:
        graph.snap(batch, static).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    q = stream.writeStream.foreachBatch(matched).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    d = spark.read.parquet(f"{folder}/out")
    return d.select("point_id", rounded(_c("snap_e"), 4).alias("snap_e"), rounded(_c("snap_n"), 4).alias("snap_n"), "snapped")


@query("x23_session_reset", ", sg as (select *, cast(floor(t / 24) as bigint) as part from sig)" + _used("trip_key, part", "sg") + f"select cast(trip_key as varchar) as session, part, count(*) as n, {R('min(t)')} as t0 from us join st using (trip_key, part) where i >= first group by trip_key, part")
def x23(spark, sf_dir):
    """Each session begins anew every 24 seconds: the first output after that waits for a fix again."""
    part = F.floor(_c("t") / 24)
    d = fusion_rows(spark, sf_dir).withColumn("part", part)
    d = d.withColumn("reset", F.coalesce(_c("part") != F.lag("part").over(Window.partitionBy("session").orderBy("t")), F.lit(False)))
    return fusion.fuse_batch(d).groupBy("session", part.alias("part")).agg(F.count("*").alias("n"), rounded(F.min("t")).alias("t0"))



@query("m01_pluggable_sources", _run_sql(_WIN0, (("walk", "north"), ("hold", "north")), f"select trip_key, speed_source, heading_source, {R('final_m', 3)} as final_m from me").replace("so as (select *,", "so as (select *, 1.4::double as v_walk, 0.0::double as h_north,"))
def m01(spark, sf_dir):
    """A source by name is a column: any pair of them can be run."""
    v = vehicle(spark, sf_dir)
    d = deadreckon.with_sources(v, fixed(v), (("hold", "truth"),)).withColumn("v_walk", F.lit(1.4)).withColumn("h_north", F.lit(0.0))
    return deadreckon.drift_metrics(deadreckon.dead_reckon(d, (("walk", "north"), ("hold", "north")))).select("trip_key", "speed_source", "heading_source", rounded(_c("final_m"), 3).alias("final_m"))


@query("t07_frontier_pop", _GRAPH + f"""select src as query, dst, {R('f', 6)} as f from (select e.src, e.dst, e.cost + sqrt(pow(n.x - g.x, 2) + pow(n.y - g.y, 2)) as f, row_number() over (partition by e.src order by e.cost + sqrt(pow(n.x - g.x, 2) + pow(n.y - g.y, 2)), e.dst) as rk from edges e join nodes n on n.id = e.dst join nodes g on g.id = (select max(id) from nodes)) z where rk = 1""")
def t07(spark, sf_dir):
    """The next node of each query by cost so far plus the straight line to the goal."""
    nodes, edges, _, _ = road(spark, sf_dir)
    goal = nodes.select(F.max_by("x", "id").alias("gx"), F.max_by("y", "id").alias("gy"))  # one row: the last node
    front = edges.select(_c("src").alias("query"), "dst", "cost").join(nodes, _c("dst") == _c("id")).crossJoin(goal)
    f = _c("cost") + F.sqrt((_c("x") - _c("gx")) ** 2 + (_c("y") - _c("gy")) ** 2)
    return front.groupBy("query").agg(F.min(F.struct(f.alias("f"), "dst")).alias("b")).select("query", "b.dst", rounded(_c("b.f")).alias("f"))


@query("s39_benchmark_series", _run_sql(_WIN0, (("hold", "gps_hold"),), f"select trip_key, i, {R('t', 4)} as t, {R('err', 3)} as err from tr"))
def s39(spark, sf_dir):
    """The error over time that a figure of a run shows."""
    v = vehicle(spark, sf_dir)
    d = deadreckon.dead_reckon(deadreckon.with_sources(v, fixed(v), (("hold", "gps_hold"),)), (("hold", "gps_hold"),))
    return d.select("trip_key", "i", rounded(_c("t"), 4).alias("t"), rounded(_c("err"), 3).alias("err"))

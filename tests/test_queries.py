"""Every registered query with SQL gives the SQL's rows on the smallest tables; a query without gives rows."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
# Some of each kind; all of them together take several minutes.
NAMES = ["p08_enu_to_latlon", "p27_rotation", "p31_turn_instruction", "w05_linear_interpolation", "w10_angle_unwrap", "w13_reflected_speed", "w17_hysteresis", "f01_native_validity", "j03_lag_correlation", "j06_as_of_distance", "a04_trip_summary", "a23_circular_mean", "d06_dead_reckon", "a09_drift_metrics", "w15_training_windows", "j14_split_lookup", "j11_snap_join", "g01_shortest_path", "s19_serial_lines"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def key(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return tuple(map(key, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", NAMES)
def test_rows_are_the_sql_rows(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(key(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(entry.oracle_sql()[name])
    names = list(rel.columns)
    assert sorted(names) == cols
    want = sorted((tuple(key(dict(zip(names, x))[c]) for c in cols) for x in rel.fetchall()), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert all(a == b or isinstance(a, float) and abs(a - b) <= 2e-3 * max(1, abs(b)) for a, b in zip(g, w)), (g, w)


def test_registry():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 150


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_truth_over_truth_hardly_drifts(spark):
    from pyspark.sql import functions as F

    from wayline.operators import deadreckon, outage
    from wayline.functions import scalar as S

    t = F.col("i") * 0.1
    d = spark.range(1200).select(F.lit(1).alias("trip_key"), F.col("id").cast("int").alias("i")).withColumns({"t": t, "speed": F.lit(10.0), "heading_deg": t * 0.5, "lat": F.lit(52.0), "lon": F.lit(-1.0)})
    a = F.radians("heading_deg")
    rate = F.radians(F.lit(0.5))
    d = d.withColumns({"e": 10 * (1 - F.cos(a)) / rate, "n": 10 * F.sin(a) / rate})
    lat, lon = S.from_enu(F.col("e"), F.col("n"), F.lit(52.0), F.lit(-1.0))
    d = d.withColumns({"lat": lat, "lon": lon})
    none = F.lit(None).cast("double")
    d = d.withColumns({c: none for c in ("gps_speed", "ind_speed_kmh")} | {"wheel": F.lit(33.0), "yaw_rate_dps": F.lit(0.5), "gyro_dps": F.lit(-0.5), "gyro_x": F.lit(0.0), "gyro_y": F.lit(0.0), "gyro_z": F.radians(F.lit(-0.5)), "grav_x": F.lit(0.0), "grav_y": F.lit(0.0), "grav_z": F.lit(9.81), "acc_x": F.lit(0.0), "acc_y": F.lit(0.0), "acc_z": F.lit(9.81), "roll": F.lit(0.0), "pitch": F.lit(0.0)})
    w = outage.outages(d, outage.SCENARIOS["isro_60s"])
    assert w.count() == 1
    m = {(r.speed_source, r.heading_source): r for r in deadreckon.drift_metrics(deadreckon.dead_reckon(deadreckon.with_sources(d, w))).collect()}
    assert m[("truth", "truth")].drift_pct < 0.1 and m[("truth", "truth")].passed and m[("hold", "truth")].final_m < 1
    assert m[("obd", "gps_hold")].drift_pct > 10

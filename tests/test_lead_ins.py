"""Calibrations before outages: overlapping lead-ins share the rows of their span."""

import math

import numpy as np
import pytest

from wayline.operators import deadreckon as D


def drive(spark, n=3000):
    rows, h = [], 0.0
    for i in range(n):
        rate = 12.0 * math.sin(i / 37) if i // 200 % 2 else 0.0
        h = (h + rate * 0.1) % 360
        rows.append((1, i, i * 0.1, h, 10.0 + math.sin(i), rate / 1.25 + 0.5, -rate * 0.8, 33.0 + i % 3, 0.0, 0.0, 9.81, 0.0, 0.0, math.radians(-rate * 0.8)))
    return spark.createDataFrame(rows, "trip_key int, i int, t double, heading_deg double, speed double, yaw_rate_dps double, gyro_dps double, wheel double, grav_x double, grav_y double, grav_z double, gyro_x double, gyro_y double, gyro_z double")


@pytest.mark.parametrize("span", [3600.0, 45.0])
def test_fifty_windows_of_a_trip(spark, monkeypatch, span):
    monkeypatch.setattr(D, "SPAN_S", span)
    d = drive(spark)
    w = spark.createDataFrame([(1, k, 500 + 40 * k, (500 + 40 * k) * 0.1 - 0.1) for k in range(50)], "trip_key int, window int, i0 int, ta double")
    dealt = D._dealt(d, w.selectExpr("trip_key", f"floor(ta / {span}) as span"), 40.0, ["t"]).count()
    assert dealt <= 2 * 3000  # the fifty lead-ins themselves hold 20,000 rows
    rate = {r.window: r for r in D.calibrate_rate(d, w, seconds=40.0).collect()}
    assert len(rate) == 50 and any(abs(r.scale - 1.25) < 0.1 for r in rate.values()) and all(abs(r.bias - 0.5) < 5 for r in rate.values())
    gyro = {r.window: r for r in D.calibrate_gyro(d, w, seconds=40.0).collect()}
    assert any(abs(r.scale + 1.25) < 0.05 for r in gyro.values())
    rows = {r.i: r for r in d.collect()}
    for r in D.wheel_radius(d, w, 40.0).collect():
        i0, ts = 500 + 40 * r.window, (500 + 40 * r.window) * 0.1 - 0.1 - 40.0
        own = [x.speed / x.wheel for i, x in rows.items() if i < i0 and x.t >= ts]
        assert r.radius == pytest.approx(np.median(own))
    phone = D.align_phone(d, w, 40.0).collect()
    assert len(phone) == 50 and all(abs(r.gz - 1) < 1e-12 for r in phone) and max(abs(r.quality) for r in phone) > 0.95
    assert D.calibrate_rate(d.limit(0), w).collect() == [] and D.wheel_radius(d, w.limit(0)).collect() == []


def test_half_turns_fall_on_the_side_of_the_sql():
    h = np.array([k * 3.6 for a in range(50) for k in (a, a + 50)])
    rate = D._true_rate({"heading_deg": h, "t": np.arange(100.0)})
    want = [math.fmod(math.fmod(b - a + 180.0, 360.0) + 360.0, 360.0) - 180.0 for a, b in zip(h, h[1:])]
    assert math.isnan(rate[0]) and rate[1:].tolist() == want


def test_all_sources_take_one_pass_over_lead_ins(spark):
    from wayline.plans import reckoning_queries as Q

    v = Q.vehicle(spark, "/root/testdata/sf0.001")
    both = D.with_sources(v, Q.fixed(v), [("wheel_speed", "veh_yawrate"), ("hold", "imu_aligned")], least=5)
    assert both._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroupsInPandas") == 1
    got = {(r.trip_key, r.window, r.i): (r.v_wheel_speed, r.h_veh_yawrate, r.h_imu_aligned) for r in both.collect()}
    for k, pair in enumerate([("wheel_speed", "truth"), ("truth", "veh_yawrate"), ("truth", "imu_aligned")]):
        c = f"v_{pair[0]}" if k == 0 else f"h_{pair[1]}"
        one = {(r.trip_key, r.window, r.i): r[c] for r in D.with_sources(v, Q.fixed(v), [pair], least=5).collect()}
        assert one == {key: x[k] for key, x in got.items()} and one

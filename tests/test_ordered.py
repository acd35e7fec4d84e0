"""Streams in order of time: stream, table and a plain restatement give the same rows."""

import math
import random

import pytest

from wayline.streaming import ordered

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture()
def streams(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def feed(name, batches, schema):
        """A stream of these batches, each a file."""
        folder = str(tmp_path / name)
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(folder)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return spark.table(name).collect()

    return feed, run


def test_latest_fix_of_a_second_input(spark, streams):
    feed, run = streams
    draw = random.Random(2)
    samples = [(s, round(k * 0.1, 3), float(k)) for s in "ab" for k in range(80)]
    fixes = [(s, round(draw.random() * 8, 3), None if draw.random() < 0.2 else draw.random(), bool(k % 3)) for s in "ab" for k in range(9)] + [("a", 2.0, 0.5, True), ("a", 2.0, 0.7, True), ("a", 3.0, 0.1, None)]
    a, b = "session string, t double, acc double", "session string, t double, lat double, valid boolean"

    def want(s, t):
        own = [f[1:] for f in fixes if f[0] == s and f[1] <= t]
        return max(own, key=lambda f: (f[0], f[1] is not None, f[1] or 0, f[2] is not None, f[2] or False), default=(None, None, None))

    table = ordered.side_input(spark.createDataFrame(samples, a), spark.createDataFrame(fixes, b), "session").collect()
    assert len(table) == 160 and all((r.fix_t, r.fix_lat, r.fix_valid) == want(r.session, r.t) for r in table)
    # Shuffled within the delay, in batches that don't fit each other; the last rows only push the watermarks on.
    for x in (samples, fixes):
        x.sort(key=lambda r: r[1] + draw.random() * 1.5)
    end = lambda x, *more: [[(s, 60.0, *more) for s in "ab"], [(s, 61.0, *more) for s in "ab"]]
    cut = lambda x, n: [x[k * len(x) // n : (k + 1) * len(x) // n] for k in range(n)]
    late = [("a", 0.05, -1.0)]  # comes when the watermark is past it: dropped
    got = run(ordered.side_input(feed("samples", [*cut(samples, 4), *end("s", 0.0), late], a), feed("fixes", [*cut(fixes, 3), *end("f", 0.0, True), *end("f", 0.0, True)], b), "session", delay="2 seconds"), "fixed")
    got = [r for r in got if r.t < 50]
    assert sorted(got, key=str) == sorted(table, key=str)


def plain(rows, period):
    """The rule, a sample at a time: (tick, t, dt_ref, v, h)."""
    out, prev, nxt, own = [], None, None, None
    for t, v, h in rows:
        if prev is None:
            prev, t0, nxt = (t, v, h), t, 0
            continue
        if t <= prev[0]:
            continue
        while t0 + nxt * period <= t:
            al = (t0 + nxt * period - prev[0]) / (t - prev[0])
            lerp = None if v is None or prev[1] is None else prev[1] + al * (v - prev[1])
            turn = None if h is None or prev[2] is None else (prev[2] + al * ((h - prev[2] + 180) % 360 - 180)) % 360
            out.append((nxt, t0 + nxt * period, al * (t - prev[0]) if al > 0 else own, lerp, turn))
            nxt += 1
        own, prev = t - prev[0], (t, v, h)
    return out


def near(a, b):
    return all((p is None and q is None) or (p is not None and q is not None and math.isclose(p, q, abs_tol=1e-9)) for p, q in zip(a, b))


def test_resampling_over_the_seam_and_missing_angles(spark, streams):
    feed, run = streams
    draw = random.Random(4)
    rows = []
    for s in "ab":
        t, h = draw.random(), 350.0
        for k in range(90):
            h = (h + draw.uniform(-3, 9)) % 360
            rows.append((s, round(t, 3), None if k == 30 else draw.gauss(0, 1), None if k in (10, 50) else h))
            t += draw.choice([0.05, 0.1, 0.13, 0.4])
    rows.append(("a", rows[5][1], 99.0, 1.0))  # of samples of one time the least counts
    rows.append(("c", 1.0, 1.0, 1.0))
    schema = "trip_key string, t double, v double, h double"
    want = {s: plain(sorted([r[1:] for r in rows if r[0] == s], key=lambda r: (r[0], -9 if r[1] is None else r[1])), 0.1) for s in "abc"}
    table = ordered.resample_from_first(spark.createDataFrame(rows, schema), 0.1, ["v"], ["h"]).collect()
    by = {(r.trip_key, r.tick): r for r in table}
    assert len(by) == len(table) == sum(map(len, want.values())) > 200
    for s, out in want.items():
        for x in out:
            r = by[s, x[0]]
            assert near((r.t, r.dt_ref, r.v, r.h), x[1:]), (r, x)
    rows.sort(key=lambda r: r[1] + draw.random() * 1.5)
    n = len(rows)
    batches = [rows[k * n // 4 : (k + 1) * n // 4] for k in range(4)] + [[(s, 900.0, 0.0, 0.0) for s in "zy"], [(s, 901.0, 0.0, 0.0) for s in "zy"], [("a", 0.001, 5.0, 5.0)]]
    got = run(ordered.resample_from_first(feed("raw", batches, schema), 0.1, ["v"], ["h"], delay="2 seconds"), "ticks")
    got = {(r.trip_key, r.tick): r for r in got if r.trip_key in ("a", "b", "c")}
    assert set(got) == set(by) and all(near((got[k].t, got[k].dt_ref, got[k].v, got[k].h), (by[k].t, by[k].dt_ref, by[k].v, by[k].h)) for k in by)


def test_empty_tables(spark):
    e = spark.createDataFrame([], "session string, t double, v double")
    assert ordered.side_input(e, e, "session").collect() == [] and ordered.resample_from_first(e, 0.1, ["v"], by="session").collect() == []
    one = spark.createDataFrame([("a", None, 1.0), ("a", 1.0, 2.0)], "session string, t double, v double")
    assert [tuple(r) for r in ordered.side_input(one, e, "session").collect()] == [("a", 1.0, 2.0, None, None)]

import math
import random

import numpy as np
import pytest

from wayline.streaming import fusion


def rows(session="s", n=900, outage=(300, 700), seed=1):
    r = random.Random(seed)
    out = []
    for k in range(n):
        t = k * 0.1
        lat = 52.0 + math.degrees(10.0 * t / fusion.RADIUS)
        valid = not outage[0] <= k < outage[1]
        out.append((session, t, r.gauss(0, 0.05), r.gauss(0, 0.05), -9.81 + r.gauss(0, 0.05), 0.2, 0.0, 0.0, 0.5, lat if valid else None, -1.0 if valid else None, valid, 10.0, 0.01, 4.0, 10.0, None, None, None))
    return out


class One:
    """A single session, a row at a time."""

    def __init__(self):
        self.all = fusion.Sessions(1)

    def push(self, r):
        d = {k: np.array([np.nan if r[k] is None else r[k]], float) for k in fusion._NUMBERS} | {"gnss_valid": np.array([r["gnss_valid"]])}
        k, out = self.all.push(np.zeros(1, int), d)
        return {c: v[0] for c, v in out.items()} if len(k) else None


def test_position_through_an_outage():
    s = One()
    names = [x.split()[0] for x in fusion.INPUT.split(", ")]
    outs = [s.push(dict(zip(names, x))) for x in rows()]
    modes = [o["mode"] for o in outs]
    assert modes[299] == "GNSS_AIDED" and modes[303] == "GNSS_AIDED" and modes[304] == "DR_ACTIVE" and modes[700] == "DR_ACTIVE" and modes[701] == "GNSS_REACQUIRE" and modes[-1] == "GNSS_AIDED"
    end = outs[690]
    true = 52.0 + math.degrees(10.0 * 69.0 / fusion.RADIUS)
    assert abs(math.radians(end["lat"] - true)) * fusion.RADIUS < 40
    assert outs[690]["pos_std"] > outs[299]["pos_std"] and min(o["window_fill"] for o in outs[60:]) == 60


def test_gates_and_reinit():
    e, two = fusion.Ekf(2), np.arange(2)
    of = lambda *x: np.array(x, float)
    e.init(two, of(52, 52), of(-1, -1), of(0, 0), of(10, 10), of(4, 4))
    assert e.position(two, of(500, 5), of(0, 0), 4.0).tolist() == [False, True] and e.x[0, 0] == 0 < e.x[1, 0]
    assert e.heading(two, np.radians(of(90, 3)), fusion.GNSS_HEADING, gate=True).tolist() == [False, True]
    plain = fusion.Ekf(1, gating=False, joseph=False)
    plain.init(two[:1], of(52), of(-1), of(0), of(10), of(4))
    assert plain.position(two[:1], of(500), of(0), 4.0).all() and np.allclose(plain.p[0], plain.p[0].T)
    s, names = One(), [x.split()[0] for x in fusion.INPUT.split(", ")]
    data = [dict(zip(names, x)) for x in rows(outage=(0, 0))]
    for d in data[:50]:
        s.push(d)
    data[50]["lat"] += 0.002
    assert s.push(data[50])["gnss_health"] == "DEGRADED" and s.all.left[0] == 4


def test_hold_and_low_pass():
    s, names = One(), [x.split()[0] for x in fusion.INPUT.split(", ")]
    outs = [s.push(dict(zip(names, x))) for x in rows(outage=(100, 900))]
    assert outs[-1]["pos_std"] == 999.0 and outs[-1]["lat"] == outs[-2]["lat"]
    h = fusion.impulse_response(80)
    assert sum(h) == pytest.approx(1.0, abs=1e-5) and abs(h[-1]) < 1e-10


def test_sessions_in_lock_step_are_sessions_alone(spark):
    data = {n: rows(n, 100 + 37 * k, (20 + k, 60 + 2 * k), k) for k, n in enumerate("abcdefg")}
    df = spark.createDataFrame([x for d in data.values() for x in d], fusion.INPUT)
    got = {(r.session, r.t): r for r in fusion.fuse_batch(df).collect()}
    names = [x.split()[0] for x in fusion.INPUT.split(", ")]
    for n, d in data.items():
        s = One()
        for x in d:
            if o := s.push(dict(zip(names, x))):
                r = got.pop((n, x[1]))
                assert r.lat == pytest.approx(o["lat"], abs=1e-12) and r.pos_std == pytest.approx(o["pos_std"]) and (r["mode"], r.phase, r.window_fill) == (o["mode"], o["phase"], o["window_fill"])
    assert not got


def test_reset_is_a_session_of_its_own(spark):
    from pyspark.sql import functions as F

    data = rows("a", 200, (40, 70)) + rows("b", 150, (0, 3), 2)
    df = spark.createDataFrame(data, fusion.INPUT)
    part = F.floor(F.col("t") / 6)
    own = {r.t: r for r in fusion.fuse_batch(df.where("session = 'a'").withColumn("session", F.concat("session", part))).collect()}
    got = fusion.fuse_batch(df.withColumn("reset", F.round(F.col("t") % 6, 6).isin(0.0, 6.0))).where("session = 'a'").collect()
    assert len(got) == len(own) and all(r.lat == pytest.approx(own[r.t].lat, abs=1e-12) and r.phase == own[r.t].phase for r in got)


def test_batch_is_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    data = rows("a", 120, (40, 70)) + rows("b", 120, (60, 90), 2)
    df = spark.createDataFrame(data, fusion.INPUT)
    want = {(r.session, r.t): r for r in fusion.fuse_batch(df).collect()}
    folder = str(tmp_path / "in")
    for k in range(2):
        df.where(f"t >= {k * 6.0} and t < {(k + 1) * 6.0}").coalesce(1).write.mode("append").json(folder)
    stream = spark.readStream.schema(fusion.INPUT).option("maxFilesPerTrigger", 1).json(folder)
    q = fusion.fuse_stream(stream).writeStream.format("memory").queryName("fused").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.session, r.t): r for r in spark.table("fused").collect()}
    assert set(got) == set(want) and len(got) == 240
    assert all(abs(got[k].lat - want[k].lat) < 1e-9 and got[k].mode == want[k].mode for k in want)


def test_silent_sessions_are_held_and_forgotten(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    data = {"a": rows("a", 120, (40, 70)), "b": rows("b", 120, (60, 90), 2), "nofix": rows("nofix", 60, (0, 60), 3)}
    clock = [[("clock", t, *rows("clock", 1)[0][2:])] for t in (70.0, 71.0, 400.0, 401.0)]
    names = [x.split()[0] for x in fusion.INPUT.split(", ")]
    every = [x for d in data.values() for x in d]
    parts = [[x for x in every if k * 4.0 <= x[1] < (k + 1) * 4.0] for k in range(3)] + clock
    folder = str(tmp_path / "in")
    for p in parts:
        spark.createDataFrame(p, fusion.INPUT).coalesce(1).write.mode("append").json(folder)
    want = {(r.session, r.t): r for r in fusion.fuse_batch(spark.createDataFrame(every, fusion.INPUT)).collect()}
    stream = spark.readStream.schema(fusion.INPUT).option("maxFilesPerTrigger", 1).json(folder)
    cp = str(tmp_path / "cp")
    q = fusion.fuse_stream_timed(stream, delay="1 second", ttl_s=200.0, buckets=3).writeStream.format("memory").queryName("held").outputMode("append").option("checkpointLocation", cp).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = [r for r in spark.table("held").collect() if r.session != "clock"]
    seen = [r for r in got if r.t < 12]
    assert len(seen) == len(want) and all(abs(r.lat - want[r.session, r.t].lat) < 1e-9 and r.mode == want[r.session, r.t].mode for r in seen)
    held = {r.session: r for r in got if r.t >= 12}
    assert len(got) - len(seen) == len(held) == 2 and all(r.pos_std == 999.0 and r.gnss_health == "OUTAGE" for r in held.values())
    for n in "ab":
        last = max((k for k in want if k[0] == n), key=lambda k: k[1])
        assert abs(held[n].lat - want[last].lat) < 1e-12 and held[n].t == pytest.approx(data[n][-1][1] + 45.0)
    left = spark.read.format("statestore").option("path", cp).option("stateVarName", "sessions").load()
    assert [r.user_map_key.session for r in left.collect()] == ["clock"]
    assert names[0] == "session"

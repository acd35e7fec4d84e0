"""Sensor fusion: filter, aligner, Kalman filter and the per-session step, shared by batch and stream.

The recursion is non-linear, so it runs in Python; everything before and after it is columns. Sessions step in lock-step: the
state of many is held as arrays, and one step takes the next row of each. State is JSON, so a stateful stream can keep and restore it.
"""

from __future__ import annotations

import json
import pickle
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RADIUS = 6_378_137.0
# Process noise per second, measurement deviations, gates, and the covariance's floors and resets.
Q = (0.01, 0.01, 0.5, 0.5, 0.005)
IMU_HEADING, GNSS_HEADING, MODEL_SPEED, GNSS_SPEED, ZUPT, NHC, ROAD = math.radians(5), math.radians(1.5), 1.0, 0.3, 0.05, 0.1, 0.087
POSITION_GATE, HEADING_GATE = 25.0, 9.0
BEFORE_INIT = (100.0**2, 100.0**2, 25.0, 25.0, math.radians(90) ** 2)
RESET = (2500.0, 2500.0, 9.0, 9.0, math.radians(45) ** 2)
FLOOR = (1e-4, 1e-4, 1e-4, 1e-4, math.radians(0.1) ** 2)
# A 4th-order Butterworth low-pass at 8 Hz for 50 Hz, two second-order sections (b0 b1 b2 a0 a1 a2).
SECTIONS = ((0.02287021, 0.04574042, 0.02287021, 1.0, -0.6020332, 0.12355934), (1.0, 2.0, 1.0, 1.0, -0.8099503, 0.51158976))


def wrap(a):
    return (a + math.pi) % (2 * math.pi) - math.pi


class Ekf:
    """n filters with state east, north, vE, vN, heading (clockwise from north). gating and joseph off give the simpler variant.

    Every step takes the places `at` of the filters that make it, and arrays with a value for each of these.
    """

    STATE = ("x", "p", "lat0", "lon0", "ready")

    def __init__(self, n: int = 1, gating: bool = True, joseph: bool = True):
        self.gating, self.joseph = gating, joseph
        self.x, self.p = np.zeros((n, 5)), np.tile(np.diag(BEFORE_INIT), (n, 1, 1))
        self.lat0, self.lon0, self.ready = np.zeros(n), np.zeros(n), np.zeros(n, bool)

    def init(self, at, lat, lon, heading, speed, accuracy) -> None:
        var = np.maximum(accuracy, 8.0) ** 2
        self.lat0[at], self.lon0[at], self.ready[at] = lat, lon, True
        self.x[at] = np.stack([np.zeros(len(at)), np.zeros(len(at)), speed * np.sin(heading), speed * np.cos(heading), wrap(heading)], axis=1)
        self.p[at] = 0.0
        self.p[at, 0, 0] = self.p[at, 1, 1] = var
        self.p[at, 2, 2] = self.p[at, 3, 3] = 1.0
        self.p[at, 4, 4] = math.radians(10) ** 2

    def repair(self, at) -> None:
        """Symmetric, finite, and no variance below its floor."""
        p = (self.p[at] + self.p[at].transpose(0, 2, 1)) / 2
        p[~np.isfinite(p).all(axis=(1, 2))] = np.diag(RESET)
        k = np.arange(5)
        p[:, k, k] = np.maximum(p[:, k, k], FLOOR)
        self.p[at] = p

    def _update(self, at, h: np.ndarray, z: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Measurement update with rows h, innovations z and covariances r; false for those where it can't be done."""
        ph = self.p[at] @ h.transpose(0, 2, 1)
        s = h @ ph + r
        fine = np.isfinite(s).all(axis=(1, 2))
        fine[fine] = np.linalg.det(s[fine]) > 0
        if not fine.all():
            at, h, z, r, ph, s = at[fine], h[fine], z[fine], r[fine], ph[fine], s[fine]
        k = ph @ np.linalg.inv(s)
        x = self.x[at] + (k @ z[:, :, None])[:, :, 0]
        x[:, 4] = wrap(x[:, 4])
        a, p = np.eye(5) - k @ h, self.p[at]
        self.x[at] = x
        self.p[at] = a @ p @ a.transpose(0, 2, 1) + k @ r @ k.transpose(0, 2, 1) if self.joseph else a @ p
        self.repair(at)
        return fine

    def _scalar(self, at, h: list, z, std) -> np.ndarray:
        n = len(at)
        rows = np.stack([np.broadcast_to(np.asarray(v, float), n) for v in h], axis=1)[:, None, :]
        return self._update(at, rows, np.broadcast_to(z, n)[:, None], np.broadcast_to(np.square(np.asarray(std, float)), n)[:, None, None])

    def _along(self, at) -> tuple:
        x = self.x[at]
        s, c = np.sin(x[:, 4]), np.cos(x[:, 4])
        return s, c, x[:, 2] * s + x[:, 3] * c, x[:, 2] * c - x[:, 3] * s

    def predict(self, at, dt) -> None:
        x, f = self.x[at], np.tile(np.eye(5), (len(at), 1, 1))
        x[:, 0] += x[:, 2] * dt
        x[:, 1] += x[:, 3] * dt
        f[:, 0, 2] = f[:, 1, 3] = dt
        self.x[at] = x
        self.p[at] = f @ self.p[at] @ f.transpose(0, 2, 1) + np.diag(Q) * np.broadcast_to(dt, len(at))[:, None, None]
        self.repair(at)
        s, c, fwd, lat = self._along(at)
        self._scalar(at, [0, 0, c, -s, -fwd], -lat, NHC)

    def heading(self, at, heading, std: float, gate: bool = False) -> np.ndarray:
        z = wrap(heading - self.x[at, 4])
        done = np.ones(len(at), bool)
        if gate and self.gating:
            done = z * z / (self.p[at, 4, 4] + std * std) <= HEADING_GATE
        done[done] = self._scalar(at[done], [0, 0, 0, 0, 1], z[done], std)
        at = at[done]
        v = np.hypot(self.x[at, 2], self.x[at, 3])
        self.x[at, 2], self.x[at, 3] = v * np.sin(self.x[at, 4]), v * np.cos(self.x[at, 4])
        return done

    def speed(self, at, v, std: float) -> np.ndarray:
        s, c, fwd, lat = self._along(at)
        return self._scalar(at, [0, 0, s, c, lat], v - fwd, max(std, 0.1))

    def position(self, at, e, n, std) -> np.ndarray:
        h = np.tile(np.eye(5)[:2], (len(at), 1, 1))
        z = np.stack([e - self.x[at, 0], n - self.x[at, 1]], axis=1)
        r = np.eye(2) * np.broadcast_to(np.square(np.asarray(std, float)), len(at))[:, None, None]
        done = np.ones(len(at), bool)
        if self.gating and len(at):
            done = np.einsum("ki,kij,kj->k", z, np.linalg.inv(self.p[at][:, :2, :2] + r), z) <= POSITION_GATE
        done[done] = self._update(at[done], h[done], z[done], r[done])
        return done

    def zupt(self, at) -> np.ndarray:
        self._scalar(at, [0, 0, 1, 0, 0], -self.x[at, 2], ZUPT)
        return self._scalar(at, [0, 0, 0, 1, 0], -self.x[at, 3], ZUPT)

    def to_enu(self, at, lat, lon) -> tuple:
        return np.radians(lon - self.lon0[at]) * RADIUS * np.cos(np.radians(self.lat0[at])), np.radians(lat - self.lat0[at]) * RADIUS

    def latlon(self, at) -> tuple:
        return self.lat0[at] + np.degrees(self.x[at, 1] / RADIUS), self.lon0[at] + np.degrees(self.x[at, 0] / (RADIUS * np.cos(np.radians(self.lat0[at]))))

    def pos_std(self, at) -> np.ndarray:
        v = (self.p[at, 0, 0] + self.p[at, 1, 1]) / 2
        return np.where(np.isfinite(v) & (v >= 0), np.sqrt(np.abs(v)), 999.0)


class LowPass:
    """The low-pass over six channels of n sessions, from zero state."""

    STATE = ("z",)

    def __init__(self, n: int = 1):
        self.z = np.zeros((n, 2, 2, 6))

    def push(self, at, v: np.ndarray) -> np.ndarray:
        for k, (b0, b1, b2, _, a1, a2) in enumerate(SECTIONS):
            y = b0 * v + self.z[at, k, 0]
            self.z[at, k, 0] = b1 * v - a1 * y + self.z[at, k, 1]
            self.z[at, k, 1] = b2 * v - a2 * y
            v = y
        return v


def impulse_response(n: int = 80) -> list[float]:
    f, one = LowPass(), np.zeros(1, int)
    return [float(f.push(one, np.full((1, 6), float(k == 0)))[0, 0]) for k in range(n)]


PHASES = np.array(["UNCALIBRATED", "STATIC_DONE", "CALIBRATED"], object)


class Aligner:
    """Tilt from 50 still samples, then yaw offset from 60 moving ones: UNCALIBRATED, STATIC_DONE, CALIBRATED."""

    STILL, MOVING = 50, 60
    STATE = ("phase", "seen", "still", "diffs", "pitch", "roll", "yaw")

    def __init__(self, n: int = 1):
        self.phase, self.seen = np.zeros(n, int), np.zeros(n, int)
        self.still, self.diffs = np.zeros((n, self.STILL, 3)), np.zeros((n, self.MOVING))
        self.pitch, self.roll, self.yaw = np.zeros(n), np.zeros(n), np.zeros(n)

    def push_static(self, at, a: np.ndarray, gyro: np.ndarray) -> None:
        on = (self.phase[at] == 0) & (gyro < 0.08)
        at, a = at[on], a[on]
        self.still[at, self.seen[at]] = a
        self.seen[at] += 1
        at = at[self.seen[at] == self.STILL]
        if len(at):
            m = self.still[at].mean(axis=1)
            norm = np.linalg.norm(m, axis=1)
            g = m / np.where(norm == 0, 1.0, norm)[:, None]
            self.pitch[at], self.roll[at], self.phase[at], self.seen[at] = np.arcsin(g[:, 0]), np.arcsin(-g[:, 1]), 1, 0

    def push_dynamic(self, at, gnss_heading, imu_heading, speed) -> None:
        on = (self.phase[at] == 1) & (speed >= 3)
        at = at[on]
        self.diffs[at, self.seen[at]] = wrap(gnss_heading[on] - imu_heading[on])
        self.seen[at] += 1
        at = at[self.seen[at] == self.MOVING]
        if len(at):
            self.yaw[at], self.phase[at], self.seen[at] = np.median(self.diffs[at], axis=1), 2, 0


@dataclass(frozen=True)
class Config:
    bad_fixes: int = 5
    good_fixes: int = 2
    hold_s: float = 45.0
    reinit_m: float = 80.0
    inflated: int = 5
    window: int = 60
    legacy_pothole: bool = False
    gating: bool = True
    joseph: bool = True
    zupt_last: bool = False  # the edge order


INPUT = "session string, t double, acc_x double, acc_y double, acc_z double, gyro_x double, gyro_y double, gyro_z double, heading_deg double, lat double, lon double, gnss_valid boolean, gnss_speed double, gnss_heading_deg double, gnss_accuracy double, model_speed double, road_e double, road_n double, road_bearing double"
OUTPUT = "session string, t double, lat double, lon double, heading_deg double, speed double, pos_std double, mode string, gnss_health string, phase string, still boolean, pothole boolean, window_fill int, model_speed double"


_OUT = [x.split()[0] for x in OUTPUT.split(", ")]
_IN = [x.split()[0] for x in INPUT.split(", ")]
_NUMBERS = [x.split()[0] for x in INPUT.split(", ") if x.endswith(" double")]


class Sessions:
    """All state of n sessions; push() takes a row for each of some of them."""

    STATE = ("t", "fix_t", "hold", "valid", "streak", "last_raw", "left", "fill")

    def __init__(self, n: int = 1, config: Config = Config()):
        self.c, self.ekf, self.filter, self.aligner = config, Ekf(n, config.gating, config.joseph), LowPass(n), Aligner(n)
        self.t, self.fix_t, self.hold = np.full(n, np.nan), np.full(n, np.nan), np.full((n, 2), np.nan)
        self.valid, self.streak, self.last_raw, self.left, self.fill = np.ones(n, bool), np.zeros(n, int), np.full(n, -1), np.zeros(n, int), np.zeros(n, int)

    def parts(self) -> dict[str, tuple[object, str]]:
        """Every array of state, by name: (owner, attribute)."""
        return {f"{k}.{name}": (x, name) for k, x in (("own", self), ("ekf", self.ekf), ("filter", self.filter), ("aligner", self.aligner)) for name in x.STATE}

    def grown(self, n: int) -> Sessions:
        """The same sessions with room for n."""
        out = Sessions(n, self.c)
        mine = self.parts()
        for k, (x, name) in out.parts().items():
            getattr(x, name)[: len(self.t)] = getattr(*mine[k])
        return out

    def forget(self, at: np.ndarray) -> None:
        """Begin these sessions anew."""
        new = Sessions(1, self.c).parts()
        for k, (x, name) in self.parts().items():
            getattr(x, name)[at] = getattr(*new[k])[0]

    def dump(self) -> str:
        return json.dumps({k: getattr(x, name).tolist() for k, (x, name) in self.parts().items()})

    def load(self, text: str) -> None:
        d = json.loads(text)
        for k, (x, name) in self.parts().items():
            getattr(x, name)[:] = d[k]

    def packed(self, k: int) -> bytes:
        """The state of one session."""
        return pickle.dumps([getattr(x, name)[k] for x, name in self.parts().values()])

    def unpack(self, k: int, state: bytes) -> None:
        for (x, name), v in zip(self.parts().values(), pickle.loads(state)):
            getattr(x, name)[k] = v

    def push(self, at: np.ndarray, r: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """A row for each session in `at` (none twice), as arrays by column. Returns which rows give an output, and the outputs:
        none for late and repeated rows and before the first fix. A row with `reset` begins its session anew."""
        c, ekf = self.c, self.ekf
        if r.get("reset") is not None:
            self.forget(at[r["reset"]])
        rows = np.flatnonzero(~(r["t"] <= self.t[at]))

        def only(keep: np.ndarray) -> None:
            nonlocal at, rows, r
            if not keep.all():
                at, rows, r = at[keep], rows[keep], {k: v[keep] for k, v in r.items()}

        if len(rows) < len(at):
            at, r = at[rows], {k: v[rows] for k, v in r.items()}
        step = r["t"] - self.t[at]
        dt = np.where(np.isnan(step), 0.02, np.clip(step, 0.001, 0.5))
        self.t[at] = r["t"]
        acc = np.nan_to_num(np.stack([r["acc_x"], r["acc_y"], r["acc_z"]], axis=1))
        gyro = np.nan_to_num(np.stack([r["gyro_x"], r["gyro_y"], r["gyro_z"]], axis=1))
        up, down = np.abs(acc[:, 2] - 9.81), np.abs(acc[:, 2] + 9.81)
        r["pothole"] = (np.maximum if c.legacy_pothole else np.minimum)(up, down) > 15
        smooth = self.filter.push(at, np.concatenate([acc, gyro], axis=1))
        self.fill[at] = np.where(r["pothole"], 1, np.minimum(c.window, self.fill[at] + 1))
        turn, norm = np.linalg.norm(gyro, axis=1), np.linalg.norm(acc, axis=1)
        self.aligner.push_static(at, smooth[:, :3], turn)
        r["model"] = np.where(self.fill[at] < c.window, np.nan, r["model_speed"])
        r["still"] = (np.abs(norm - 9.81) < 0.5) & (turn < (0.08 if c.zupt_last else 0.15)) & (not c.zupt_last or np.nan_to_num(r["model"]) < 0.3)
        raw = r["gnss_valid"] & ~np.isnan(r["lat"]) & ~np.isnan(r["lon"]) & ~((r["lat"] == 0) & (r["lon"] == 0))
        self.streak[at] = np.where(raw == self.last_raw[at], self.streak[at] + 1, 1)
        self.last_raw[at] = raw
        before = self.valid[at]
        self.valid[at] = (before | raw & (self.streak[at] >= c.good_fixes)) & ~(~raw & (self.streak[at] >= c.bad_fixes))
        r["use"], r["back"], r["dt"] = self.valid[at] & raw, self.valid[at] & ~before, dt
        r["accuracy"] = np.where(np.isnan(r["gnss_accuracy"]), 8.0, r["gnss_accuracy"])
        r["course"] = np.where(r["gnss_heading_deg"] == 0, np.nan, np.radians(r["gnss_heading_deg"]))
        only(ekf.ready[at] | r["use"])
        new = ~ekf.ready[at]
        ekf.init(at[new], r["lat"][new], r["lon"][new], np.nan_to_num(r["course"][new]), np.nan_to_num(r["gnss_speed"][new]), r["accuracy"][new])
        self.left[at[r["back"]]] = 2
        ekf.predict(at, r["dt"])
        turned = ~np.isnan(r["heading_deg"])
        ekf.heading(at[turned], wrap(np.radians(r["heading_deg"][turned]) + self.aligner.yaw[at[turned]]), IMU_HEADING)
        moving = ~np.isnan(r["model"]) & ~r["still"]
        ekf.speed(at[moving], r["model"][moving], MODEL_SPEED)
        if not c.zupt_last:
            ekf.zupt(at[r["still"]])
        self._fixes(at[r["use"]], {k: v[r["use"]] for k, v in r.items()})
        on_road = ~np.isnan(r["road_e"]) & ~np.isnan(r["road_n"])
        ekf.position(at[on_road], r["road_e"][on_road], r["road_n"][on_road], np.where(r["use"][on_road], 15.0, 3.0))
        on_road &= ~np.isnan(r["road_bearing"])
        ekf.heading(at[on_road], r["road_bearing"][on_road], ROAD)
        if c.zupt_last:
            ekf.zupt(at[r["still"]])
        lat, lon = ekf.latlon(at)
        held = r["t"] - self.fix_t[at] > c.hold_s
        fresh = held & np.isnan(self.hold[at, 0])
        self.hold[at[fresh]] = np.stack([lat[fresh], lon[fresh]], axis=1)
        lat, lon = np.where(held, self.hold[at, 0], lat), np.where(held, self.hold[at, 1], lon)
        valid, left = self.valid[at], self.left[at] > 0
        return rows, {
            "t": r["t"], "lat": lat, "lon": lon, "heading_deg": np.degrees(ekf.x[at, 4]) % 360, "speed": np.hypot(ekf.x[at, 2], ekf.x[at, 3]), "pos_std": np.where(held, 999.0, ekf.pos_std(at)),
            "mode": np.where(valid, np.where(left, "GNSS_REACQUIRE", "GNSS_AIDED"), "DR_ACTIVE"), "gnss_health": np.where(valid, np.where(left, "DEGRADED", "OK"), "OUTAGE"),
            "phase": PHASES[self.aligner.phase[at]], "still": r["still"], "pothole": r["pothole"], "window_fill": self.fill[at].astype(np.int32), "model_speed": r["model"],
        }

    def _fixes(self, at: np.ndarray, r: dict[str, np.ndarray]) -> None:
        """The updates of sessions with a fix that is used."""
        c, ekf = self.c, self.ekf
        e, n = ekf.to_enu(at, r["lat"], r["lon"])
        far = np.hypot(e - ekf.x[at, 0], n - ekf.x[at, 1]) > c.reinit_m
        course = np.where(np.isnan(r["course"]), ekf.x[at, 4], r["course"])
        ekf.init(at[far], r["lat"][far], r["lon"][far], course[far], np.nan_to_num(r["gnss_speed"][far]), r["accuracy"][far])
        self.left[at[far]] = c.inflated
        ekf.position(at, *ekf.to_enu(at, r["lat"], r["lon"]), r["accuracy"] + 20.0 * self.left[at] / c.inflated)
        self.left[at] = np.maximum(0, self.left[at] - 1)
        some = ~np.isnan(r["gnss_speed"])
        ekf.speed(at[some], r["gnss_speed"][some], GNSS_SPEED)
        fast = ~np.isnan(r["course"]) & (np.nan_to_num(r["gnss_speed"]) > 1.5)
        both = fast & ~np.isnan(r["heading_deg"])
        self.aligner.push_dynamic(at[both], r["course"][both], np.radians(r["heading_deg"][both]), r["gnss_speed"][both])
        ekf.heading(at[fast], r["course"][fast], GNSS_HEADING, gate=True)
        self.fix_t[at], self.hold[at] = r["t"], np.nan


def _columns(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    flags = [c for c in ("gnss_valid", "reset") if c in pdf.columns]
    return {k: pdf[k].to_numpy(float, na_value=np.nan) for k in _NUMBERS} | {c: pdf[c].fillna(False).to_numpy(bool) for c in flags}


def _input(rows: DataFrame) -> DataFrame:
    return rows.select(*_IN, *[c for c in rows.columns if c == "reset"])


def _steps(sessions: Sessions, at: np.ndarray, pdf: pd.DataFrame) -> pd.DataFrame:
    """Outputs of rows in order of time: the first row of every session in one step, then the second ones, and so on."""
    r, nth = _columns(pdf), pd.Series(at).groupby(at).cumcount().to_numpy()
    order = np.argsort(nth, kind="stable")
    edges = np.append(np.flatnonzero(np.diff(nth[order], prepend=-1)), len(order))
    kept, parts = [], []
    for a, z in zip(edges[:-1], edges[1:]):
        rows = order[a:z]
        k, out = sessions.push(at[rows], {c: v[rows] for c, v in r.items()})
        kept.append(rows[k])
        parts.append(out)
    place = np.concatenate(kept) if kept else np.zeros(0, int)
    out = pd.DataFrame({c: np.concatenate([p[c] for p in parts]) if parts else [] for c in _OUT[1:]})
    out.insert(0, "session", pdf["session"].to_numpy()[place])
    return out.iloc[np.argsort(place, kind="stable")]


def fuse_batch(rows: DataFrame, config: Config = Config()) -> DataFrame:
    """Outputs of every session of a table with the columns of INPUT; a boolean column `reset`, if there is one, clears a session's
    state before its row is taken.

    Sessions are dealt to tasks and a task's rows go by in order of time, so that it steps all its sessions at once, and holds
    their states and one batch of rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sessions, known = Sessions(64, config), {}
        for pdf in batches:
            at = np.array([known.setdefault(s, len(known)) for s in pdf["session"]], int)
            if len(known) > len(sessions.t):
                sessions = sessions.grown(2 * len(known))
            yield _steps(sessions, at, pdf)

    return _input(rows).repartition("session").sortWithinPartitions("t").mapInPandas(run, OUTPUT)


def fuse_stream(rows: DataFrame, config: Config = Config()) -> DataFrame:
    """The same for a stream: a session's state is kept between batches; rows that come late are dropped."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    class Processor(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("session", "state string")

        def handleInputRows(self, key, batches, timerValues) -> Iterator[pd.DataFrame]:
            s = Sessions(1, config)
            if self.state.exists():
                s.load(self.state.get()[0])
            parts = list(batches)
            out = None
            if parts:
                pdf = pd.concat(parts).sort_values("t", kind="stable")
                out = _steps(s, np.zeros(len(pdf), int), pdf)
            self.state.update((s.dump(),))
            if out is not None:
                yield out

        def close(self) -> None:
            pass

    return _input(rows).groupBy("session").transformWithStateInPandas(Processor(), outputStructType=OUTPUT, outputMode="Append", timeMode="None")


def fuse_stream_timed(rows: DataFrame, config: Config = Config(), delay: str = "10 seconds", ttl_s: float = 600.0, buckets: int = 256) -> DataFrame:
    """fuse_stream() with a clock of event time: a session whose fix is `config.hold_s` old gives its held position once, without any row coming,
    and a session without rows for `ttl_s` is forgotten; one that comes back begins anew.

    Sessions are dealt to `buckets` keys, and a key steps all sessions of a batch at once; each has a state of its own, stored as bytes.
    Rows of a batch are taken in order of time; rows of no session or time are left out, as are those behind the watermark.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    from .ordered import SHIFT_S, timed

    def due(t: float) -> int:
        return int((t + SHIFT_S) * 1000)

    class Buckets(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.sessions = handle.getMapState("sessions", "session string", "state binary, seen double, fix double")

        def handleInputRows(self, key, batches, timerValues) -> Iterator[pd.DataFrame]:
            pdf = pd.concat(list(batches)).sort_values("t", kind="stable")
            at, names = pd.factorize(pdf["session"])
            s, known = Sessions(len(names), config), {}
            for k, name in enumerate(names):
                if self.sessions.containsKey((name,)):
                    known[k] = self.sessions.getValue((name,))
                    s.unpack(k, known[k][0])
            out = _steps(s, at, pdf)
            seen = pdf.groupby(at)["t"].max()
            timers = set()
            for k, name in enumerate(names):
                last = max(seen[k], known[k][1] if k in known else seen[k])
                fix = None if np.isnan(s.fix_t[k]) else float(s.fix_t[k])
                self.sessions.updateValue((name,), (s.packed(k), float(last), fix))
                timers |= {due(last + ttl_s), *([due(fix + config.hold_s)] if fix is not None and fix + config.hold_s > last else [])}
            for t in timers:
                self.handle.registerTimer(t)
            yield out

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            now, out = timerValues.getCurrentWatermarkInMs(), []
            for (name,), (state, seen, fix) in list(self.sessions.iterator()):
                if fix is not None and seen < fix + config.hold_s and due(fix + config.hold_s) <= now:
                    s, one = Sessions(1, config), np.zeros(1, int)
                    s.unpack(0, state)
                    (lat,), (lon,) = s.ekf.latlon(one)
                    lat, lon = (lat, lon) if np.isnan(s.hold[0, 0]) else s.hold[0]
                    out.append((name, fix + config.hold_s, float(lat), float(lon), float(np.degrees(s.ekf.x[0, 4]) % 360), float(np.hypot(s.ekf.x[0, 2], s.ekf.x[0, 3])), 999.0, "DR_ACTIVE", "OUTAGE", str(PHASES[s.aligner.phase[0]]), False, False, int(s.fill[0]), None))
                    s.hold[0] = lat, lon
                    self.sessions.updateValue((name,), (s.packed(0), seen, None))
                if due(seen + ttl_s) <= now:
                    self.sessions.removeKey((name,))
            if out:
                yield pd.DataFrame(out, columns=_OUT)

        def close(self) -> None:
            pass

    d = timed(_input(rows).where("session is not null and t is not null"), "t", delay).withColumn("bucket", F.pmod(F.xxhash64("session"), F.lit(buckets)).cast("int"))
    return d.groupBy("bucket").transformWithStateInPandas(Buckets(), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")

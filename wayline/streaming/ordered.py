"""Streams whose rows come late and out of order, taken in order of time: a second input beside the samples, and resampling.

Rows wait in the state of their key until the watermark has passed them; an event-time timer then releases them, sorted. What a step keeps of
a key (the latest fix, the last sample) goes when the key has been silent for `ttl_s` of event time. Each function also takes tables, and gives
the same rows: a stream's rows are a table's once its watermark is past them. Rows behind the watermark are dropped.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

#: Event times are this many seconds on, because a stream drops what is not after its first watermark, 0.
SHIFT_S = 86_400
Step = Callable[[tuple, object, pd.DataFrame], tuple[object, pd.DataFrame]]


class Ordered(StatefulProcessor):
    """Holds a key's rows until the watermark has passed them, then hands them to `step` in order of `order`, with what it kept before."""

    def __init__(self, schema: StructType, t: str, order: list[str], step: Step, ttl_s: float):
        self.schema, self.t, self.order, self.step, self.ttl_ms = schema, t, order, step, int(ttl_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.schema)
        self.kept = handle.getValueState("kept", "kept binary, last bigint")

    def _due(self, pdf: pd.DataFrame) -> np.ndarray:
        return np.floor((pdf[self.t].to_numpy(float) + SHIFT_S) * 1000).astype(np.int64)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.schema.names)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))[self.schema.names]
        pdf = pdf[pdf[self.t].notna()]
        if len(pdf):
            values = pdf.astype(object).where(pdf.notna(), None)
            self.rows.appendList([tuple(r) for r in values.itertuples(index=False, name=None)])
            self.handle.registerTimer(int(self._due(pdf).min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        pdf = self._frame(list(self.rows.get())) if self.rows.exists() else self._frame([])
        state, last = (pickle.loads(k[0]), k[1]) if (k := self.kept.get() if self.kept.exists() else None) else (None, None)
        due = self._due(pdf) if len(pdf) else np.zeros(0, np.int64)
        ready, wait = pdf[due <= now], pdf[due > now]
        if len(ready):
            state, out = self.step(key, state, ready.sort_values(self.order, kind="stable", na_position="first").reset_index(drop=True))
            last = int(due[due <= now].max())
            self.kept.update((pickle.dumps(state), last))
            if len(wait):
                self.rows.put([tuple(r) for r in wait.astype(object).where(wait.notna(), None).itertuples(index=False, name=None)])
            else:
                self.rows.clear()
            if len(out):
                yield out
        if len(wait):
            self.handle.registerTimer(int(due[due > now].min()))
        elif last is not None:
            if now > last + self.ttl_ms:
                self.kept.clear()
            else:
                self.handle.registerTimer(last + self.ttl_ms)

    def close(self) -> None:
        pass


# Names that begin with an underscore don't reach a stateful processor.
def timed(rows: DataFrame, t: str, delay: str) -> DataFrame:
    return rows.withColumn("ts__", F.timestamp_micros(((F.col(t) + SHIFT_S) * 1e6).cast("long"))).withWatermark("ts__", delay)


def _ordered(rows: DataFrame, by: str, t: str, order: list[str], step: Step, out: StructType, ttl_s: float) -> DataFrame:
    kept = StructType([f for f in rows.schema.fields if f.name not in (by, "ts__")])
    return rows.groupBy(by).transformWithStateInPandas(Ordered(kept, t, order, step, ttl_s), outputStructType=out, outputMode="Append", timeMode="EventTime")


# ---------------------------------------------------------------- a second input

def side_input(samples: DataFrame, fixes: DataFrame, by: str, t: str = "t", delay: str = "10 seconds", ttl_s: float = 600.0) -> DataFrame:
    """samples with the columns of the latest fix (prefixed fix_, its time among them) at or before each of them; nulls before a key's first.

    Both are tables or both are streams, of independent rates. Of several fixes of one time the greatest by its columns, in their order, counts.
    Samples and fixes without a time are left out. A stream gives a sample when the watermarks of both inputs have passed it, so a late fix
    within `delay` still counts for the samples after it.
    """
    values = [c for c in fixes.columns if c != by]
    names = [f"fix_{c}" for c in values]
    own = [c for c in samples.columns if c not in (by, t)]
    out = StructType([*samples.schema.fields, *(StructField(n, fixes.schema[c].dataType) for n, c in zip(names, values))])
    empty = lambda cols, schema: [F.lit(None).cast(schema[c].dataType) for c in cols]

    def tagged(s: DataFrame, f: DataFrame, more: list[str]) -> DataFrame:
        s = s.select(by, t, *own, *[x.alias(n) for x, n in zip(empty(values, fixes.schema), names)], F.lit(1).alias("kind__"), *more)
        f = f.select(by, t, *[x.alias(n) for x, n in zip(empty(own, samples.schema), own)], *[F.col(c).alias(n) for c, n in zip(values, names)], F.lit(0).alias("kind__"), *more)
        return s.unionByName(f)

    if not samples.isStreaming:
        both = tagged(samples, fixes, []).where(F.col(t).isNotNull())
        fix = F.last(F.when(F.col("kind__") == 0, F.struct(*names)), ignorenulls=True).over(Window.partitionBy(by).orderBy(t, "kind__", *names).rowsBetween(Window.unboundedPreceding, 0))
        return both.withColumn("__fix", fix).where("kind__ = 1").select(*samples.columns, *[F.col("__fix")[n].alias(n) for n in names])

    def step(key: tuple, state: object, pdf: pd.DataFrame) -> tuple[object, pd.DataFrame]:
        is_fix = pdf["kind__"].to_numpy() == 0
        at = np.maximum.accumulate(np.where(is_fix, np.arange(len(pdf)), -1))
        seen = [tuple(r) for r in pdf[names].astype(object).where(pdf[names].notna(), None).itertuples(index=False, name=None)]
        rows = [seen[k] if k >= 0 else state or (None,) * len(names) for k in at]
        found = pd.DataFrame(rows, columns=names, index=pdf.index).astype(object)
        result = pdf[[t, *own]].assign(**{by: key[0]}, **{n: found[n] for n in names})[~is_fix][out.names]
        return (rows[-1] if at[-1] >= 0 else state), result

    both = tagged(timed(samples, t, delay), timed(fixes, t, delay), ["ts__"])
    return _ordered(both, by, t, [t, "kind__", *names], step, out, ttl_s)


# ---------------------------------------------------------------- resampling

def _last_tick(t, t0, period: float):
    """The number of the last tick at or before t, ticks being t0 + n * period; for columns."""
    n = F.floor((t - t0) / period)
    return n + F.when(t0 + (n + 1) * period <= t, 1).when(t0 + n * period > t, -1).otherwise(0)


def resample_from_first(rows: DataFrame, period: float, values: list[str], angles: list[str] = [], by: str = "trip_key", t: str = "t", delay: str = "10 seconds", ttl_s: float = 600.0) -> DataFrame:
    """(by, tick, t, dt_ref, values, angles): ticks every `period` from a key's first sample on, interpolated between samples.

    values are linear, angles (degrees) go the short way round and lie in [0, 360); either is null where one of both samples has none.
    dt_ref is the time since the sample before the tick, or that sample's own interval where the tick falls on it. Of samples of one
    time the least by its columns counts; those without a time are left out. A table or a stream; of a stream, rows in any order within `delay`.
    """
    cols = [*values, *angles]
    d = rows.select(by, t, *[F.col(c).cast("double").alias(c) for c in cols]).where(F.col(t).isNotNull())
    out = StructType([StructField(by, rows.schema[by].dataType), StructField("tick", IntegerType()), *(StructField(c, DoubleType()) for c in (t, "dt_ref", *cols))])
    if not rows.isStreaming:
        w = Window.partitionBy(by).orderBy(t, *cols)
        d = d.withColumns({"__a": F.lag(t).over(w), "__t0": F.min(t).over(Window.partitionBy(by))}).where("__a is null or __a < " + t).drop("__a")
        w = Window.partitionBy(by).orderBy(t)
        d = d.withColumns({"__b": F.lead(t).over(w), "__p": F.col(t) - F.lag(t).over(w), **{f"__{c}": F.lead(c).over(w) for c in cols}}).where("__b is not null")
        first = F.when(F.col(t) == F.col("__t0"), F.lit(0)).otherwise(_last_tick(F.col(t), F.col("__t0"), period) + 1)
        last = _last_tick(F.col("__b"), F.col("__t0"), period)
        d = d.withColumn("tick", F.explode(F.when(first <= last, F.sequence(first, last))))
        at = F.col("__t0") + F.col("tick") * period
        alpha = (at - F.col(t)) / (F.col("__b") - F.col(t))
        turn = lambda c: F.pmod(F.col(f"__{c}") - F.col(c) + 180.0, F.lit(360.0)) - 180.0
        made = [(F.col(c) + alpha * (F.col(f"__{c}") - F.col(c))).alias(c) for c in values] + [F.pmod(F.col(c) + alpha * turn(c), F.lit(360.0)).alias(c) for c in angles]
        return d.select(by, F.col("tick").cast("int").alias("tick"), at.alias("__at"), F.when(alpha > 0, alpha * (F.col("__b") - F.col(t))).otherwise(F.col("__p")).alias("dt_ref"), *made).withColumnRenamed("__at", t)

    def step(key: tuple, state: object, pdf: pd.DataFrame) -> tuple[object, pd.DataFrame]:
        x = pdf[[t, *cols]].to_numpy(float)
        t0, before, interval = state if state else (x[0, 0], None, np.nan)
        if before is not None:
            x = np.concatenate([[before], x])
        keep = np.append(True, np.diff(np.maximum.accumulate(x[:, 0])) > 0)
        x = x[keep]
        times = x[:, 0]
        n = np.floor((times - t0) / period)
        n += np.where(t0 + (n + 1) * period <= times, 1, np.where(t0 + n * period > times, -1, 0))
        if before is None:
            n[0] = -1
        count = np.diff(n).astype(int)
        k = np.repeat(np.arange(len(count)), count)
        tick = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + n[:-1][k] + 1
        a, b, at = x[k], x[k + 1], t0 + tick * period
        alpha = (at - a[:, 0]) / (b[:, 0] - a[:, 0])
        made = {c: a[:, 1 + j] + alpha * (b[:, 1 + j] - a[:, 1 + j]) for j, c in enumerate(values)}
        for j, c in enumerate(angles, 1 + len(values)):
            made[c] = np.mod(a[:, j] + alpha * (np.mod(b[:, j] - a[:, j] + 180.0, 360.0) - 180.0), 360.0)
        step_before = np.append(interval, np.diff(times))
        dt = np.where(alpha > 0, alpha * (b[:, 0] - a[:, 0]), step_before[k] if len(k) else 0.0)
        result = pd.DataFrame({by: [key[0]] * len(k), "tick": tick.astype(np.int32), t: at, "dt_ref": dt, **made})
        result = result.astype({c: object for c in ("dt_ref", *cols)})
        return (t0, x[-1], step_before[-1]), result.where(result.notna(), None)[out.names]

    return _ordered(timed(d, t, delay), by, t, [t, *cols], step, out, ttl_s)

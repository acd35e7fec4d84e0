"""A recurrent speed model over rolling windows of samples: gated recurrent layers and a linear head, in numpy inside tasks.

Weights, scaler and window length come from a model folder. A sample gets a speed once its sequence has a full window since it began
or was last reset. Windows are never built as rows: a task walks sorted samples, keeps the last window - 1 of them, and
projects each sample through the first layer once for all windows that hold it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from .model import Metadata, load_json, load_metadata, save_json
from .prep import FEATURES

#: Rows of a sequence that one task walks; longer sequences are cut, and each part also gets the window before it.
SEGMENT = 1 << 18
#: Windows that are stepped at once.
AT_ONCE = 2048
LARGEST = 64 << 20


@dataclass
class Layer:
    """Gate weights stacked as reset, update, new: w_in (3 h, inputs), w_state (3 h, h), b_in and b_state (3 h)."""

    w_in: np.ndarray
    w_state: np.ndarray
    b_in: np.ndarray
    b_state: np.ndarray


@dataclass
class Recurrent:
    layers: list[Layer]
    head: np.ndarray
    bias: float

    def count(self) -> int:
        """Number of parameters."""
        return sum(a.size for x in self.layers for a in (x.w_in, x.w_state, x.b_in, x.b_state)) + self.head.size + 1

    def over(self, projected: np.ndarray) -> np.ndarray:
        """The head's output for windows (m, steps, 3 h) whose samples went through the first layer's w_in and b_in."""
        m, steps, _ = projected.shape
        states = [np.zeros((m, x.w_state.shape[1]), projected.dtype) for x in self.layers]
        for k in range(steps):
            gates = projected[:, k]
            for n, layer in enumerate(self.layers):
                if n:
                    gates = states[n - 1] @ layer.w_in.T + layer.b_in
                states[n] = _step(gates, states[n], layer)
        return states[-1] @ self.head + self.bias


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _step(gates: np.ndarray, state: np.ndarray, layer: Layer) -> np.ndarray:
    h = state.shape[1]
    own = state @ layer.w_state.T + layer.b_state
    reset, update = _sigmoid(gates[:, :h] + own[:, :h]), _sigmoid(gates[:, h : 2 * h] + own[:, h : 2 * h])
    new = np.tanh(gates[:, 2 * h :] + reset * own[:, 2 * h :])
    return new + update * (state - new)


def random_weights(inputs: int, hidden: int, layers: int, seed: int, dtype: str = "float32") -> Recurrent:
    """Weights from a seed, evenly within 1 / sqrt(hidden): trained weights are not part of this repository."""
    rng, edge = np.random.default_rng(seed), hidden**-0.5
    draw = lambda *shape: rng.uniform(-edge, edge, shape).astype(dtype)
    return Recurrent([Layer(draw(3 * hidden, hidden if k else inputs), draw(3 * hidden, hidden), draw(3 * hidden), draw(3 * hidden)) for k in range(layers)], draw(hidden), float(draw(1)[0]))


def save_model(spark: SparkSession, model: Recurrent, meta: dict, folder: str) -> None:
    """metadata.json and weights: a Parquet table (name, shape, dtype, values)."""
    rows = [(f"layers.{k}.{name}", a) for k, x in enumerate(model.layers) for name, a in vars(x).items()] + [("head", model.head), ("bias", np.array([model.bias], model.head.dtype))]
    spark.createDataFrame([(n, list(a.shape), str(a.dtype), a.ravel().astype(float).tolist()) for n, a in rows], "name string, shape array<int>, dtype string, values array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/weights")
    save_json(spark, meta | {"weights": "weights"}, f"{folder}/metadata.json")


def load_model(spark: SparkSession, folder: str) -> tuple[Metadata, Recurrent]:
    """Metadata and weights of a model folder; weights are bounded by LARGEST bytes."""
    meta = load_metadata(spark, f"{folder}/metadata.json")
    table = spark.read.parquet(f"{folder}/{load_json(spark, f'{folder}/metadata.json').get('weights', 'weights')}")
    if (size := table.agg(F.sum(F.size("values"))).first()[0] * 8) > LARGEST:
        raise ValueError(f"{size} bytes of weights")
    found = {r.name: np.array(r["values"], r.dtype).reshape(r.shape) for r in table.collect()}
    layers = 1 + max(int(n.split(".")[1]) for n in found if n.startswith("layers."))
    return meta, Recurrent([Layer(*(found[f"layers.{k}.{n}"] for n in ("w_in", "w_state", "b_in", "b_state"))) for k in range(layers)], found["head"], float(found["bias"][0]))


def speeds(rows: DataFrame, model: Recurrent, meta: Metadata, by: str = "trip_key", order: str = "i", features: tuple[str, ...] = FEATURES, reset: str | None = None, eps: float = 0.0, blank: tuple[str, ...] = ()) -> DataFrame:
    """rows with model_speed (m/s, at least 0): null until a window is full, and where the window holds a missing value.

    order numbers each sequence's rows from 0 without gaps. reset names a boolean column: such a row begins anew (null: no). Missing values
    of the features in `blank` count as 0. eps is added to the scaler's deviations. Sequences longer than SEGMENT rows are walked in
    parts by several tasks.
    """
    w, n_in = meta.window, len(features)
    mean, std = np.asarray(meta.x_mean[:n_in]), np.asarray(meta.x_std[:n_in]) + eps
    if model.layers[0].w_in.shape[1] != n_in or len(mean) != n_in:
        raise ValueError(f"the model takes {model.layers[0].w_in.shape[1]} features, the scaler {len(mean)}; {n_in} are given")
    sent = rows.sparkSession.sparkContext.broadcast(model)
    part = F.floor(F.col(order) / SEGMENT)
    d = rows.withColumn("__part", F.explode(F.when(F.col(order) % SEGMENT > SEGMENT - w, F.array(part, part + 1)).otherwise(F.array(part))))
    # Columns of the walk: the last two tell the rows that a part only looks back on, and those where it begins.
    d = d.withColumn("__back", part != F.col("__part"))
    d = d.repartition(by, "__part").sortWithinPartitions(by, "__part", order)
    fields = rows.schema.fields
    zero = [f in blank for f in features]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net: Recurrent = sent.value
        kind = net.head.dtype
        first = net.layers[0]
        kept, since, last = np.zeros((0, len(first.b_in)), kind), 0, None
        for pdf in batches:
            x = pdf[list(features)].to_numpy(float)
            x[:, zero] = np.nan_to_num(x[:, zero], nan=0.0)
            gates = ((x.astype(kind) - mean.astype(kind)) / std.astype(kind)) @ first.w_in.T + first.b_in
            keys = list(zip(pdf[by], pdf["__part"]))
            begins = np.array([k != p for k, p in zip(keys, [last, *keys[:-1]])])
            if reset:
                begins |= pdf[reset].fillna(False).to_numpy(bool)
            at, marks = np.arange(len(pdf)), np.flatnonzero(begins)
            before = np.searchsorted(marks, at, side="right") - 1
            run_length = np.where(before >= 0, at - marks[before] + 1, at + since + 1) if len(marks) else at + since + 1
            full = np.flatnonzero((run_length >= w) & ~pdf["__back"].to_numpy(bool))
            joined = np.concatenate([kept, gates])
            out = np.full(len(pdf), np.nan)
            if len(full):
                windows = np.lib.stride_tricks.sliding_window_view(joined, w, axis=0)  # (rows, gates, steps)
                for k in range(0, len(full), AT_ONCE):
                    some = full[k : k + AT_ONCE]
                    out[some] = np.maximum(meta.y_mean + net.over(windows[some + len(kept) - w + 1].transpose(0, 2, 1)).astype(float) * meta.y_std, 0.0)
            kept, since, last = joined[max(0, len(joined) - w + 1) :].copy(), int(run_length[-1]) if len(pdf) else since, keys[-1] if keys else last
            own = ~pdf["__back"].to_numpy(bool)
            speed = pd.Series(out, index=pdf.index)
            yield pdf.assign(model_speed=speed.astype(object).where(speed.notna(), None))[[f.name for f in fields] + ["model_speed"]][own]

    schema = StructType([*(StructField(f.name, f.dataType) for f in fields), StructField("model_speed", DoubleType())])
    assert reset is None or isinstance(rows.schema[reset].dataType, BooleanType)
    return d.mapInPandas(run, schema)

"""Speed models over windows of samples: the interface, scaling, a stand-in model, and comparison of two runs."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Predict = Callable[[np.ndarray], np.ndarray]


def window_mean_model(weights: list[float], bias: float = 0.0) -> Predict:
    """A deterministic stand-in, linear in the window's channel means: trained weights are not part of this repository."""
    w = np.asarray(weights)
    return lambda x: x.mean(axis=1) @ w + bias


def save_json(spark: SparkSession, value: dict[str, Any], path: str) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_json(spark: SparkSession, path: str) -> dict[str, Any]:
    """A small JSON file, or a folder that save_json() wrote."""
    return json.loads(spark.read.text(path, wholetext=True).where("trim(value) <> ''").first()[0])


@dataclass
class Metadata:
    window: int
    x_mean: list[float]
    x_std: list[float]
    y_mean: float
    y_std: float
    input_name: str
    output_name: str


def load_metadata(spark: SparkSession, path: str) -> Metadata:
    """A model's window, scaler and names. The scaler stands in the metadata, or in the file beside it that they name (only
    the first word counts), or else in scaler.json."""
    meta, beside = load_json(spark, path), path.rpartition("/")[0]
    scaler = meta.get("scaler") or "scaler.json"
    if not isinstance(scaler, dict):
        named = str(scaler).split()[0]
        try:
            scaler = load_json(spark, f"{beside}/{named if named.endswith('.json') else 'scaler.json'}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            scaler = load_json(spark, f"{beside}/scaler.json")
    window = meta.get("sequence_length", meta.get("window_length", 60))
    return Metadata(int(window), [float(x) for x in scaler["x_mean"]], [float(x) for x in scaler["x_std"]], float(scaler["y_mean"]), float(scaler["y_std"]), meta["input_name"], meta["output_name"])


def save_calibration(biases: DataFrame, path: str) -> None:
    """Keys, accel_bias and gyro_bias (three numbers each) as JSON, an object a line."""
    biases.write.mode("overwrite").json(path)


def load_calibration(spark: SparkSession, path: str, keys: str = "") -> DataFrame:
    return spark.read.schema(", ".join(filter(None, [keys, "accel_bias array<double>, gyro_bias array<double>"]))).json(path)


def predict_speed(windows: DataFrame, load: Callable[[], Predict], x_mean: list[float], x_std: list[float], y_mean: float, y_std: float, column: str = "X", eps: float = 0.0) -> DataFrame:
    """Add model_speed: inputs are standardised, the model's output is scaled back and floored at 0.

    load() runs once per worker task, so a model is read once and not per batch. A window that is null gets null.
    """
    mean, std = np.asarray(x_mean), np.asarray(x_std) + eps

    def run(batches):
        model = load()
        for pdf in batches:
            out = np.full(len(pdf), np.nan)
            ok = pdf[column].notna().to_numpy()
            if ok.any():
                x = [np.stack(v) for v in pdf.loc[ok, column]]
                at, lengths = np.flatnonzero(ok), np.array([len(v) for v in x])
                for n in np.unique(lengths):  # windows of one length at a time
                    same = np.flatnonzero(lengths == n)
                    out[at[same]] = np.maximum(y_mean + model((np.stack([x[k] for k in same]) - mean) / std) * y_std, 0.0)
            yield pdf.assign(model_speed=pd.Series(out, index=pdf.index).astype(object).where(ok, None))

    from pyspark.sql.types import DoubleType, StructField, StructType

    return windows.mapInPandas(run, StructType([*windows.schema.fields, StructField("model_speed", DoubleType())]))


def rmse(p: Column, t: Column) -> Column:
    return F.sqrt(F.avg((p - t) ** 2))


def mae(p: Column, t: Column) -> Column:
    return F.avg(F.abs(p - t))


def compare_runs(rows: DataFrame, by: str, old: str, new: str, truth: str, limit: float = 0.05) -> DataFrame:
    """One row: mean RMSE of two predictions over groups, their difference, and whether it is within the limit."""
    per = rows.groupBy(by).agg(rmse(F.col(old), F.col(truth)).alias("r0"), rmse(F.col(new), F.col(truth)).alias("r1"))
    return per.agg(F.avg("r0").alias("old_rmse"), F.avg("r1").alias("new_rmse"), (F.avg("r1") - F.avg("r0")).alias("delta")).withColumn("verdict", F.when(F.abs("delta") < limit, "equal").otherwise("differs"))

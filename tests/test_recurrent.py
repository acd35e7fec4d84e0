"""The recurrent speed model against a restatement in plain numbers, sample by sample."""

import math
import random

import pytest

from wayline.operators import recurrent
from wayline.operators.prep import FEATURES


def plain(model, window, mean, std, y_mean, y_std):
    """One window by the equations of the gates, a number at a time."""
    s = lambda x: 1 / (1 + math.exp(-x))
    states = [[0.0] * x.w_state.shape[1] for x in model.layers]
    for row in window:
        x = [(v - m) / d for v, m, d in zip(row, mean, std)]
        for n, layer in enumerate(model.layers):
            h, old = len(states[n]), states[n]
            i = [sum(float(a) * b for a, b in zip(w, x)) + float(c) for w, c in zip(layer.w_in, layer.b_in)]
            o = [sum(float(a) * b for a, b in zip(w, old)) + float(c) for w, c in zip(layer.w_state, layer.b_state)]
            r, z = [s(i[k] + o[k]) for k in range(h)], [s(i[h + k] + o[h + k]) for k in range(h)]
            new = [math.tanh(i[2 * h + k] + r[k] * o[2 * h + k]) for k in range(h)]
            states[n] = x = [(1 - z[k]) * new[k] + z[k] * old[k] for k in range(h)]
    return max(y_mean + (sum(float(a) * b for a, b in zip(model.head, states[-1])) + model.bias) * y_std, 0.0)


def test_parameters_of_the_known_size():
    assert recurrent.random_weights(12, 128, 2, 0).count() == 153_729


@pytest.mark.parametrize("segment", [1 << 18, 16])
def test_rows_are_those_of_the_equations(spark, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(recurrent, "SEGMENT", segment)
    draw, w = random.Random(5), 7
    mean, std = [draw.random() for _ in FEATURES], [1 + draw.random() for _ in FEATURES]
    scaler = {"x_mean": mean, "x_std": std, "y_mean": 12.4, "y_std": 8.3}
    folder = f"file://{tmp_path}/model"
    recurrent.save_model(spark, recurrent.random_weights(12, 5, 2, 3, "float64"), {"sequence_length": w, "scaler": scaler, "input_name": "x", "output_name": "y"}, folder)
    meta, model = recurrent.load_model(spark, folder)
    rows = []
    for trip, n in (("a", 45), ("b", 6), ("c", 7), (None, 12)):
        for i in range(n):
            v = [draw.gauss(0, 2) for _ in FEATURES]
            if (trip, i) in (("a", 20), ("c", 2)):
                v[9] = None  # roll: counts as 0
            if (trip, i) == ("a", 38):
                v[0] = None
            rows.append((trip, i, trip == "a" and i == 12, *v))
    d = spark.createDataFrame(rows, ", ".join(["trip_key string, i int, shock boolean", *(f"{f} double" for f in FEATURES)])).repartition(3)
    got = {(r.trip_key, r.i): r.model_speed for r in recurrent.speeds(d, model, meta, reset="shock", blank=("roll", "pitch", "yaw")).collect()}
    assert len(got) == len(rows)
    by = {}
    for trip, i, shock, *v in rows:
        own = by.setdefault(trip, [])
        if shock:
            own.clear()
        own.append([0.0 if x is None and k > 8 else x for k, x in enumerate(v)])
        window = own[-w:]
        if len(window) < w or any(x is None for row in window for x in row):
            assert got[trip, i] is None
        else:
            assert got[trip, i] == pytest.approx(plain(model, window, mean, std, 12.4, 8.3), abs=1e-9)
    assert sum(v is not None for v in got.values()) > 30


def test_single_precision_is_near_and_empty_tables_are_fine(spark):
    meta = recurrent.Metadata(3, [0.0], [1.0], 1.0, 2.0, "x", "y")
    double, single = (recurrent.random_weights(1, 8, 2, 1, k) for k in ("float64", "float32"))
    d = spark.createDataFrame([(1, i, math.sin(i)) for i in range(30)], "trip_key int, i int, v double")
    a, b = ([r.model_speed for r in recurrent.speeds(d, m, meta, features=("v",)).orderBy("i").collect()] for m in (double, single))
    assert a[:2] == b[:2] == [None, None] and a[2:] == pytest.approx(b[2:], abs=1e-4)
    assert recurrent.speeds(d.limit(0), double, meta, features=("v",)).collect() == []
    with pytest.raises(ValueError):
        recurrent.speeds(d, double, meta, features=("v", "i"))

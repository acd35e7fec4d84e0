import math
import random
from fractions import Fraction

import numpy as np

from wayline.llm import whitening as W


def whole(v):
    return [math.floor(64 * c) + 1_000_000 for c in v]


def check(spark, rows, components=16, schema="vec_id long, embedding array<double>, n int"):
    """The rows of fit and whiten against exact sums and a plain eigenvalue routine."""
    vectors = spark.createDataFrame([(k, v, 5) for k, v in rows], schema)
    model = W.fit(vectors, components=components)
    got = W.whiten(vectors, model).collect()
    good = [(k, whole(v)) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    listed = sorted(set(map(lambda r: tuple(r[1]), good)))
    n, sums = len(listed), [sum(c) for c in zip(*listed)]
    a = np.array([[float(Fraction(n * x - s, n)) for x, s in zip(v, sums)] for v in listed])
    e, vecs = np.linalg.eigh(a.T @ a / n)
    e, vecs = e[::-1], vecs[:, ::-1]
    c = min(components, int((e > 1e-18 * max(e[0], 1e-300)).sum()), len(e)) if len(model.eigenvalues) else 0
    c = min(c, len(model.eigenvalues))
    assert len(got) == len(good) * len(model.eigenvalues)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
        assert r.n == n and r.identity_error <= 1e-8
    for k, x in good:
        own = [r for r in by[k] if r.component <= c]
        far = [n * p - s for p, s in zip(x, sums)]
        for r in own:
            assert r.deviation == (t if (t := sum(f * f for f in far)) < 2**63 else None)
            want = abs(np.array([float(Fraction(f, n)) for f in far]) @ vecs[:, r.component - 1]) / math.sqrt(e[r.component - 1])
            assert abs(abs(r.whitened) - want) <= 1e-6 * max(1, want), (k, r, want)
            assert abs(r.explained / (e[r.component - 1] / e.sum()) - 1) < 1e-6
    return model


def rows_of(seed, n, d, scale):
    draw = np.random.default_rng(seed)
    mixed = draw.normal(size=(n, d)) @ draw.normal(size=(d, d)) * scale
    return [(k, v.tolist()) for k, v in enumerate(mixed)]


def test_plain_repeated_and_unusable_rows(spark):
    rows = rows_of(1, 300, 8, 1.0)
    rows += [(k + 300, rows[0][1]) for k in range(200)] + [(600, None), (601, [1.0, None] + [0.0] * 6), (602, [math.nan] + [0.0] * 7), (603, [math.inf] + [0.0] * 7), (604, []), (None, rows[3][1])]
    model = check(spark, [r for r in rows if r[0] is not None])
    assert model.n == 300
    assert W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), model).where("vec_id is null").count() == 8


def test_badly_scaled_columns(spark):
    rows = [(k, (np.array(v) * 10.0 ** np.arange(-1, 5)).tolist()) for k, v in rows_of(2, 400, 6, 1.0)]
    check(spark, rows, components=4)


def test_dependent_and_constant_columns_get_no_component(spark):
    rows = [(k, [v[0], v[0], v[1], 3.0]) for k, v in rows_of(3, 200, 2, 4.0)]
    assert len(check(spark, rows).eigenvalues) == 2
    assert len(check(spark, [(k, [float(k), float(k * k)]) for k in range(2)]).eigenvalues) == 1


def test_one_vector_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(5)], schema)
    model = W.fit(same)
    assert model.n == 1 and W.whiten(same, model).collect() == []
    none = spark.createDataFrame([(1, None), (2, [])], schema)
    assert W.fit(none) is None and W.whiten(none, None).collect() == []
    assert W.fit(none.limit(0)) is None


def test_sums_beyond_a_long(spark):
    draw = random.Random(4)
    rows = [(k, [draw.choice([-1, 1]) * draw.random() * 2.0**54 for _ in range(3)]) for k in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = W.fit(vectors)
    got = W.whiten(vectors, model).collect()
    assert model.sums == tuple(map(sum, zip(*(whole(v) for _, v in rows)))) and all(r.deviation is None for r in got) and model.identity_error < 1e-8


def test_the_vectors_of_another_length_go(spark):
    rows = rows_of(5, 40, 3, 2.0) + [(100, [1.0, 2.0]), (101, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = W.fit(vectors)
    assert len(model.sums) == 3 and model.n == 40 and W.whiten(vectors, model).count() == 40 * 3

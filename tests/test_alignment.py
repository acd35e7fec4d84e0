"""Correlations by lag against numbers rolled round and correlated one lag at a time."""

import numpy as np
import pytest

from wayline.operators import alignment


@pytest.mark.parametrize("block", [1 << 16, 64])
def test_lags_by_transforms(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    rng, lags = np.random.default_rng(3), [-40, -7, -1, 0, 1, 2, 13, 60 if block > 64 else 50]
    series, rows = {}, []
    for k, n in ((1, 333), (2, 40 if block > 64 else 70), (3, 128), (4, 5), (5, 200)):
        x = np.cumsum(rng.normal(size=n)) + 1000
        y = np.roll(x, 13) + rng.normal(size=n) * 0.1 + 5
        x[rng.random(n) < 0.1] = np.nan
        y[rng.random(n) < 0.1] = np.nan
        if k == 5:
            y[:] = 1000.7  # no spread
        series[k] = x, y
        rows += [(k, i, None if np.isnan(a) and i % 2 else float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    d = spark.createDataFrame(rows, "trip_key int, i int, a double, b double").repartition(3)
    got = {(r.trip_key, r.lag): r for r in alignment.lag_correlations(d, lags, least=20, floor=1000.0).collect()}
    for k, (x, y) in series.items():
        for lag in lags:
            p = np.roll(x, lag)
            ok = np.isfinite(p) & np.isfinite(y) & (np.nan_to_num(y) > 1000)
            r = got.get((k, lag))
            assert (r.n if r else 0) == ok.sum()
            if r and ok.sum() >= 20 and k != 5:
                assert r.r == pytest.approx(np.corrcoef(p[ok], y[ok])[0, 1], abs=1e-9)
            elif r:
                assert r.r is None
    best = {r.trip_key: r.lag for r in alignment.best_lag(alignment.lag_correlations(d, lags, least=20, floor=1000.0)).collect()}
    assert best[1] == 13 and best[3] == 13 and 5 not in best
    with pytest.raises(ValueError):
        alignment.lag_correlations(d, [block])

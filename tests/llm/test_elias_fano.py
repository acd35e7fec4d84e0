import numpy as np
import pytest

from wayline.llm.elias_fano import EliasFano


@pytest.mark.parametrize("n,universe", [(0, 10), (1, 1), (1, 2**60), (500, 500), (3000, 10**6), (2000, 2**62), (4000, 300)])
def test_access_and_successor(n, universe):
    r = np.random.default_rng(n)
    v = np.sort(r.integers(0, universe, n))
    e = EliasFano.build(v, universe)
    assert (e.get(np.arange(n)) == v).all()
    q = np.concatenate([v, np.maximum(v - 1, 0), v + 1, r.integers(0, universe, 200)])
    assert (e.find(q) == np.searchsorted(v, q, side="left")).all()
    if n > 1000 and universe < 2**40:
        assert e.nbytes() < 8 * n

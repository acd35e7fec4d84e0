import random

import numpy as np
import pytest

from wayline.llm import jaccard_join as jj


def shingles(t):
    w = "".join(c.lower() if c < "\x80" else c for c in t or "").split()
    return {tuple(w[k : k + 4]) for k in range(len(w) - 3)} or ({tuple(w)} if w else set())


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((d, len(s), find(d)) for d, s in sets)


def fixture(seed):
    r = random.Random(seed)
    words = [f"W{k}é" for k in range(300)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    rows, bases = [], [text(r.choice([3, 4, 5, 8, 15, 40, 90, 200])) for _ in range(40)]
    passage = text(60)
    for b in bases:
        for _ in range(r.choice([1, 1, 2, 3, 12])):
            v = list(b)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                v[r.randrange(len(v))] = r.choice(words)
            if r.random() < 0.3:
                v = v + text(r.randint(1, max(1, len(v) // 12)))
            rows.append(" ".join(v))
    for _ in range(40):
        rows.append(" ".join(passage + text(r.randint(1, 30))))
    rows += [None, "", " \n", "a", "A", "b a", "x " * 3000, "x " * 2000]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = fixture(seed)
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, n int, class int")
    got = sorted(tuple(x) for x in jj.near_duplicates(df).collect())
    assert got == brute(rows)


def test_large_buckets_in_blocks(spark, monkeypatch):
    """A passage that hundreds of texts share, near copies by the hundred and long texts, with buckets cut into blocks of 20 and few keys held at once."""
    monkeypatch.setattr(jj, "SHARD_ROWS", 2_000)
    monkeypatch.setattr(jj, "HOT", 5)
    r = random.Random(9)
    word = lambda: f"v{r.randrange(10**7)}"
    base, passage, long = [word() for _ in range(300)], [word() for _ in range(60)], [word() for _ in range(30_000)]
    rows = []
    for _ in range(250):
        v = list(base)
        v[r.randrange(300)] = v[r.randrange(300)] = word()
        rows.append(" ".join(v))
    rows += [" ".join(passage + [word() for _ in range(r.randint(4, 50))]) for _ in range(200)]
    for k in range(4):
        v = list(long)
        for _ in range(500 * k):
            v[r.randrange(len(v))] = word()
        rows.append(" ".join(v))
    rows = list(enumerate(rows))
    got = sorted(tuple(x) for x in jj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=20).collect())
    assert got == brute(rows)


def test_keys_lose_no_pair():
    r = np.random.default_rng(4)
    for _ in range(3000):
        n = int(r.choice([1, 2, 5, 6, 7, 8, 9, 13, 14, 20, 40, 100, 230]))
        a = r.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)
        b = a[r.random(n) > r.choice([0, 0.05, 0.1])]
        b = np.concatenate([b, r.integers(0, 2**63, int(r.integers(0, 1 + n // 9)), dtype=np.int64).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 85 * (len(a) + len(b) - both):
            assert set(jj.bucket_keys(a)) & set(jj.bucket_keys(b))
            assert np.minimum(jj.point(a), jj.point(b)).sum() >= jj.least_overlap(len(a), len(b))


def test_tree_gives_all_pairs_within_the_bound():
    r = np.random.default_rng(5)
    points = r.integers(0, 9, (300, jj.DIMS)).astype(np.int32)
    points[100:] = np.maximum(0, points[:200] + r.integers(-1, 2, (200, jj.DIMS)) * (r.random((200, jj.DIMS)) < 0.1))
    sizes = points.sum(axis=1).astype(np.int64)
    got = {tuple(sorted(p)) for i, j in jj.Tree(points, sizes).join() for p in zip(i.tolist(), j.tolist())}
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if np.minimum(points[i], points[j]).sum() >= jj.least_overlap(sizes[i], sizes[j])}
    assert got == want and want


@pytest.mark.parametrize("m, n", [(300, 7), (1, 40), (40, 1), (90, 300), (1, 1)])
def test_two_trees_give_all_pairs_within_the_bound(m, n):
    r = np.random.default_rng(m)
    points = r.integers(0, 3, (m + n, jj.DIMS)).astype(np.uint16)
    points[m:] = points[r.integers(0, m, n)]
    sizes = points.sum(axis=1).astype(np.int64)
    got = sorted(p for i, j in jj.Tree(points[:m], sizes[:m]).join(85, jj.Tree(points[m:], sizes[m:]), block=3) for p in zip(i.tolist(), j.tolist()))
    want = [(i, j) for i in range(m) for j in range(n) if np.minimum(points[i], points[m + j]).sum() >= jj.least_overlap(sizes[i], sizes[m + j])]
    assert got == want and want


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (1, "z y"), (0, "Z Y"), (None, "z y")], "doc_id long, text string")
    assert sorted(map(tuple, jj.near_duplicates(df).collect()), key=repr) == [(0, 1, 0), (1, 1, 0), (1, 2, 1), (1, 2, 1), (None, 1, None)]
    assert jj.near_duplicates(df.limit(0)).collect() == []

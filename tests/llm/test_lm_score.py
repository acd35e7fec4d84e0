import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from wayline.llm import lm_score


def brute(rows, order=3, least=1):
    toks = [(d, "".join(c.lower() if c < "\x80" else c for c in x or "").split() + [None]) for d, x in rows]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d, _ in rows]
    grams = [Counter() for _ in range(order + 1)]
    for h, (_, t) in zip(held, toks):
        if not h:
            for k in range(1, order + 1):
                grams[k].update(tuple(t[j : j + k]) for j in range(len(t) - k + 1))
    n, v = sum(grams[1].values()), len(grams[1])
    kept = [None, grams[1], *({g: c for g, c in grams[k].items() if c >= least} for k in range(2, order + 1))]
    mass = Counter()
    for k in range(2, order + 1):
        for g, c in kept[k].items():
            mass[g[:-1]] += (c - 0.75) / grams[k - 1][g[:-1]]

    def prob(g):
        if len(g) == 1:
            return (grams[1][g] + 0.5) / (n + 0.5 * (v + 1))
        context = g[:-1]
        if context not in kept[len(context)]:
            return prob(g[1:])
        return ((kept[len(g)][g] - 0.75) / grams[len(context)][context] if g in kept[len(g)] else 0) + (1 - mass[context]) * prob(g[1:])

    out = []
    for h, (d, t) in zip(held, toks):
        base = sum(math.log10(prob((w,))) for w in t)
        full = sum(math.log10(prob(tuple(t[max(0, j - order + 1) : j + 1]))) for j in range(len(t)))
        out.append((d, h, len(t), sum(grams[1][(w,)] > 0 for w in t), n, base, full))
    return out


def test_places_of_more_than_64_bits():
    r = np.random.default_rng(3)
    shard, code = r.integers(0, 9, 2000), r.integers(0, 40, 2000)
    order, first = lm_score.distinct(shard, code, 40)
    other, also = lm_score.distinct(shard, code, 2**61)
    assert (shard[order] == shard[other]).all() and (code[order] == code[other]).all() and (first == also).all()
    assert list(zip(shard[order][first], code[order][first])) == sorted(set(zip(shard.tolist(), code.tolist())))


@pytest.mark.parametrize("least, shards", [(1, 8), (2, 8), (1, 1024)])
def test_against_definition(spark, least, shards):
    """With many shards, common words are cut between their children."""
    r = random.Random(9)
    words = [f"w{k}É" for k in range(50)]
    rows = []
    for k in range(300):
        t, w = [], 0
        for _ in range(r.randint(0, 60)):
            w = (w * 7 + r.choice([1, 1, 1, 2, 5])) % 50 if r.random() < 0.9 else r.randrange(50)
            t.append(words[w].upper() if r.random() < 0.1 else words[w])
        rows.append((k, " ".join(t) + (" rare%d" % k if k % 9 == 0 else "")))
    rows += [(400, None), (401, ""), (None, "w1É w2É"), (402, "long " * 20_000), (402, "long " * 20_000)]
    df = spark.createDataFrame([(*x, 1.0) for x in rows], "doc_id long, text string, score double")
    got = sorted((tuple(x) for x in lm_score.train_and_score(df, least_count=least, shards=shards).collect()), key=repr)
    want = sorted(brute(rows, least=least), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], abs=1.5e-4 * w[2]), (g, w)
    held = [x for x in got if x[1]]
    assert sum(x[6] for x in held) > sum(x[5] for x in held) * 0.9  # closer to 0: better than the unigram on unseen texts


def test_no_rows_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    held = zlib.crc32(b"1") % 5
    out = lm_score.train_and_score(df, fold=held).collect()
    assert out[0].n_known == 0 and out[0].train_tokens == 0 and out[0].n_tokens == 3
    assert lm_score.train_and_score(df.limit(0)).collect() == []

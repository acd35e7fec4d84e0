import hashlib
import random
import re
import zlib

import numpy as np

from wayline.llm import periodic_runs as P

GAP = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least=6, exponent=4):
    """Every period tried on its own."""
    n, out = len(w), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            a = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            x = w[a : i + p]
            if len(x) >= max(least, exponent * p) and not any(x[q:] == x[:-q] for q in range(1, p)):
                out.append((a, len(x), p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(draw, most, letters):
    w = [draw.randrange(letters) for _ in range(draw.randint(0, most))]
    if w and draw.random() < 0.7:
        a = draw.randrange(len(w))
        p = draw.randint(1, max(1, (len(w) - a) // 3))
        w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
    return w


def test_lyndon_lengths():
    draw = random.Random(1)
    for _ in range(1500):
        w = [draw.randrange(draw.choice([1, 2, 3, 5])) for _ in range(draw.randint(1, 30))]
        assert P.lyndon_lengths(w) == [next((j for j in range(i + 1, len(w)) if w[i:] >= w[j:]), len(w)) - i for i in range(len(w))]


def test_runs_of_many_texts():
    draw = random.Random(2)
    for _ in range(1200):
        texts = [periodic(draw, 40, draw.choice([1, 2, 3, 8])) for _ in range(draw.randint(0, 5))]
        exponent, least = draw.choice([2, 3, 4]), draw.choice([2, 4, 6])
        rows = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        got = P.runs_of(np.array(sum(texts, []), np.int64), rows, least, exponent)
        assert got.tolist() == [[a + int(rows[k]), n, p] for k, x in enumerate(texts) for a, n, p in brute(x, least, exponent)]


def test_long_texts_take_linear_steps():
    for w in ([1] * 50_000, [1, 2] * 25_000, [1, 2, 3, 1, 2] * 10_000):
        (start, length, period), *more = P.runs_of(np.array(w), np.array([0, len(w)])).tolist()
        assert (start, length) == (0, 50_000) and not more


def collapse(w, runs):
    gone = {k for a, n, p in runs for k in range(a + p, a + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def test_frames(spark):
    rows = [(1, "x a\tb a b  a b\na b y", 7), (1, " go go go go go go ", 8), (2, None, None), (3, "", 0), (4, " \n ", 0), (None, "é é é é é é é", 1), (5, "plain words  only", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = P.find_runs(docs).collect()
    for r, (k, t, _) in zip(got, rows):
        w = GAP.findall(t or "")
        want = brute(w)
        assert (r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (k, len(w), want, collapse(w, want))
    assert got[0].collapsed == "x a b y" and got[5].collapsed == "é"
    assert P.find_runs(docs.limit(0)).collect() == []


def test_query(spark):
    from wayline.llm.queries import op12_periodic_runs

    got = {r.doc_id: r for r in op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    found = 0
    for doc_id, text in docs:
        w = GAP.findall(text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        if n > 3000 and h % 10:
            continue  # the brute force is quadratic
        runs = brute(w)
        found += len(runs)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        r = got[doc_id]
        assert r.n_runs == len(runs) and (best or (None,) * 3) == (r.start, r.length, r.period) and r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapse(w, runs).encode()).hexdigest()
    assert found > 5

"""Token counts, quality rules, URL filter, mixing, against the library or a plain restatement."""

import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wayline.llm import mixing, quality_rules, token_counts, url_filter
from wayline.llm.queries import URL_RULES

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("'srtvlmed  \n\t1a.!é"), st.characters(exclude_categories=["Cs"])), max_size=40), min_size=1, max_size=5))
def test_token_counts(texts):
    assert list(token_counts.tokenizer(PATH).count_column(pa.array(texts))) == library(texts)


def test_token_count_edges(spark):
    texts = [None, "", "<|endoftext|>a<|endoftext|>", "<|endoftext", "a" * 9000, " " * 3000 + "x", "x y " * 50_000, "it's 'll 'r'r"]
    df = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)] + [(0, "x", 7)], "doc_id long, text string, n_tokens int")
    out = sorted(map(tuple, token_counts.count_tokens(df, PATH).collect()))
    want = sorted((k, len((t or "").encode()), n, n > 512) for (k, t), n in zip([*enumerate(texts), (0, "x")], library([*texts, "x"])))
    assert out == want and token_counts.count_tokens(df.limit(0), PATH).collect() == []
    # Chunk maps compose to the same marks as one pass.
    import numpy as np

    c = np.random.default_rng(0).integers(0, 12, 5000).astype(np.uint8)
    c[-1] = token_counts.STOP
    state, begins = token_counts.START, np.zeros(len(c) + 1, bool)
    for k, x in enumerate(c):
        state, m = token_counts._move(state, int(x))
        begins[k] |= bool(m & token_counts.HERE)
        begins[k - 1] |= bool(m & token_counts.BEFORE)
    assert (token_counts.split_marks(c) == begins[:-1]).all()


def statistics(text):
    import re

    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = Counter(zip(w, w[1:], w[2:]))
    rep = {i + j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines), len(lines) - len(set(lines)), len(rep)


def test_quality_rules(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(3, 7)))
    rows = []
    for k in range(900):
        text = "\n".join(" ".join(word() for _ in range(12)) for _ in range(r.randint(3, 9)))
        if k % 5 == 0:
            text = text.replace(" ", "*** ") if k % 10 else " ".join(text.split()[:40] * 4)
        rows.append((k, text, "en" if k % 3 else None))
    rows += [(1000, None, "en"), (1001, "", None), (1002, "a " * 20_000, "fr"), (1003, " \n\x0b\t", "en"), (1004, "x\ny\nx\nx", "fr"), (3, rows[3][1], None), (3, rows[3][1], None)]
    docs = spark.createDataFrame([(*x, 5) for x in rows], "doc_id long, text string, lang string, kept int")
    labels = spark.createDataFrame([(k, int(k % 5 != 0)) for k in range(900)] + [(1, None), (2, 1)], "doc_id long, quality int")
    out = quality_rules.judge(docs.drop("kept"), labels).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for x in out:
        by[x.doc_id].append(x)
    for k, t, _ in rows:
        n, chars, sym, _, dup, rep = statistics(t)
        x = by[k][0]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (n, chars, sym, dup, rep)
        assert x.base_failed == (n < 50 or 100 * rep > 50 * n) and not (x.base_failed and x.kept)
    good = [x for x in out if x.doc_id < 900 and x.doc_id % 5 and not x.base_failed]
    bad = [x for x in out if x.doc_id < 900 and x.doc_id % 5 == 0]
    assert sum(not x.kept for x in good) <= 0.025 * len(good) and not any(x.kept for x in bad)
    assert all(x.kept != x.base_failed for x in quality_rules.judge(docs.drop("kept"), labels.limit(0)).collect())
    assert quality_rules.judge(docs.limit(0), labels).collect() == []


def test_binomial_tail(spark):
    from pyspark.sql import functions as F

    cases = [(0, 10), (3, 10), (10, 10), (7, 400), (0, 5000), (120, 5000)]
    p = 0.025
    df = spark.createDataFrame(cases, "k long, n long")
    for r in df.select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), p).alias("q")).collect():
        exact = sum(math.comb(r.n, i) * Fraction(1, 40) ** i * Fraction(39, 40) ** (r.n - i) for i in range(r.k + 1))
        assert abs(r.q - float(exact)) < 1e-9 * max(1e-3, float(exact)) + 1e-12


def url_brute(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(c.lower() if c < "\x80" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_url_filter(spark):
    r = random.Random(4)
    parts = ["http://", "https://", "com", "net", "org", "example.", "x.", "/en/", "/de/8", "/en/7", "/es/", "?", "#", "a", "EXAMPLE.", "://", "\n"]
    urls = ["".join(r.choice(parts) for _ in range(r.randint(0, 7))) for _ in range(1500)] + [None, "", "x" * 5000, "http://example.com/en/7", "http://com/en/", "http://.com/en/"]
    pages = spark.createDataFrame([(k, u, "z") for k, u in enumerate(urls)] + [(0, urls[0], "z")], "page_id long, url string, other string")
    rules = spark.createDataFrame([*URL_RULES, (None, "/", "block")], "host string, path string, verdict string")
    out = url_filter.filter_urls(pages, rules).collect()
    assert sorted(((x.page_id, x.host, x.path, x.rule, x.verdict) for x in out), key=repr) == sorted([(k, *url_brute(u)) for k, u in [*enumerate(urls), (0, urls[0])]], key=repr)
    # A filter of one block only gives more false positives.
    small = url_filter.filter_urls(pages, rules, max_filter_bytes=64).collect()
    assert Counter(map(tuple, small)) == Counter(map(tuple, out))
    assert all(x.verdict == "allow" and x.rule is None for x in url_filter.filter_urls(pages, rules.limit(0)).collect())


def test_url_filter_with_rules_of_very_many_lengths(spark):
    rules = spark.createDataFrame([("org", "/" + "a" * k, "block" if k % 2 else "allow") for k in range(5000)], "host string, path string, verdict string")
    pages = spark.createDataFrame([(k, "http://" + "x." * 300 + "org/" + "a" * k + "b") for k in (0, 1, 2, 4097, 4999, 6000)], "page_id long, url string")
    got = {x.page_id: (len(x.rule), x.verdict) for x in url_filter.filter_urls(pages, rules).collect()}
    assert got == {k: (4 + min(k, 4999), "block" if min(k, 4999) % 2 else "allow") for k in (0, 1, 2, 4097, 4999, 6000)}


def test_mixing(spark):
    r = random.Random(6)
    rows = [(k, " ".join("w" for _ in range(min(4000, int(r.paretovariate(1.1) * 20)))), r.choice(["a", "b", "b", "b", "c", "d", "é", None])) for k in range(3000)]
    rows += [(5000, None, "a"), (5001, "", "empty"), (5002, " \n", "empty"), (5, rows[5][1], rows[5][2]), (None, "w w", "a")]
    df = spark.createDataFrame([(*x, 3, 4) for x in rows], "doc_id long, text string, source string, copies int, target int").drop("copies", "target")
    out = mixing.mix(df).collect()
    assert len(out) == len(rows) and sorted(map(tuple, out), key=repr) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=repr)
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction((5, 2, 1)[k % 3]) for k, s in enumerate(names)}
    target, free = {}, set(names)
    total = Fraction(sum(size.values()))
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * size[s]}
        if not over:
            break
        target |= {s: Fraction(3 * size[s]) for s in over}
        free -= over
    target |= {s: weight[s] * level for s in free}
    taken = Counter()
    for x in out:
        assert x.size >= 0 and x.taken % max(x.size, 1) == 0 and x.taken <= 3 * x.size and x.source_size == size[x.source]
        assert abs(x.target - float(target[x.source])) < 1e-6 * max(1, x.target)
        taken[x.source] += x.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= max((x.size for x in out if x.source == s), default=0) + 1
    assert mixing.mix(df.limit(0)).collect() == []


def test_systematic_copies(spark):
    df = spark.createDataFrame([(k, "s", 10, 0.37) for k in range(1000)], "doc_id long, source string, size int, expected double")
    for buckets in (1, 30, 1024):
        c = [x.copies for x in mixing.systematic_copies(df, buckets=buckets).collect()]
        assert set(c) <= {0, 1} and abs(sum(c) - 370) <= 1
    # Rows without an id share a bucket, whatever they add up to.
    many = spark.createDataFrame([(None, "s", 10, 300_000.25, str(k % 3)) for k in range(400)], "doc_id long, source string, size int, expected double, t string")
    assert abs(sum(x.copies for x in mixing.systematic_copies(many, tie="t").collect()) - 400 * 300_000.25) <= 1


def test_size_class(spark):
    df = spark.createDataFrame([(k,) for k in [*range(0, 5000), 2**40 - 1, 2**40 + 2**37]], "size long")
    for r in df.select("size", mixing.size_class(df["size"]).alias("c")).collect():
        n = r["size"] + 1
        high = n.bit_length() - 1
        assert r.c == high * 8 + (n * 8 >> high) % 8

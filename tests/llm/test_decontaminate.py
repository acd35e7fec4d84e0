import random
from collections import Counter

from wayline.llm import decontaminate


def brute(docs, items):
    out = set()
    for i, t in items:
        w = (t or "").lower().split()
        if not w:
            continue
        k = min(5, len(w))
        mine = Counter(zip(*(w[j:] for j in range(k))))
        for d, x in docs:
            v = (x or "").lower().split()
            for s in range(len(v) - len(w) + 1):
                if not any(v[s + j : s + j + k] == w[j : j + k] for j in range(len(w) - k + 1)):
                    continue  # not aligned
                c = Counter(zip(*(v[s + j : s + len(w)] for j in range(k))))
                least = sum((c & mine).values())
                if least and least / sum((c | mine).values()) >= 0.8:
                    out.add((d, i, s, len(w), round(least / sum((c | mine).values()), 9)))
    return out


def test_against_all_windows(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(k, text(r.randint(15, 59))) for k in range(25)] + [(100, "one two"), (101, "a b c d e f g"), (102, ""), (103, None), (104, "x x x x x x x x x x x x")]
    docs = []
    for k in range(60):
        v = text(r.randint(0, 150)).split()
        if k % 2:
            w = r.choice(items[:25])[1].split()
            if k % 4 == 1:
                w[r.choice([0, 1, -1, -2])] = "changed"
            at = r.randint(0, len(v))
            v[at:at] = w
        docs.append((k, " ".join(v)))
    docs += [(200, "so One\nTWO it is"), (201, "y " + "x " * 30), (202, None), (203, ""), (204, "a b c d e f g"), (204, "a b c d e f g"), (205, "z " * 5000 + items[0][1])]
    df = spark.createDataFrame([(*x, 5) for x in docs], "doc_id long, text string, m int")
    bench = spark.createDataFrame([(*x, 5) for x in items], "item_id long, text string, n int")
    rows = decontaminate.leaks(df, bench).collect()
    got = {(x.doc_id, x.item_id, x.start, x.words, round(x.similarity, 9)) for x in rows}
    assert len(rows) == len(got) and got == brute(docs, items) and len(got) > 30
    left = {x.doc_id for x in decontaminate.clean(df, bench).collect()}
    assert left == {d for d, _ in docs} - {x[0] for x in got}
    assert decontaminate.leaks(df.limit(0), bench).collect() == [] and decontaminate.leaks(df, bench.limit(0)).collect() == []


def test_blocks_find_all_within_radius(spark):
    r = random.Random(1)
    pairs = []
    for x in [r.getrandbits(64) - 2**63 for _ in range(200)]:
        y = x
        for b in r.sample(range(64), r.randint(0, decontaminate.RADIUS)):
            y ^= 1 << b if b < 63 else -(2**63)
        pairs.append((x, y))
    from pyspark.sql import functions as F

    b = spark.createDataFrame(pairs, "x long, y long").select(decontaminate.blocks(F.col("x"), decontaminate.ITEM_FLIPS).alias("p"), decontaminate.blocks(F.col("y"), decontaminate.WINDOW_FLIPS).alias("q")).collect()
    assert all(set(map(tuple, z.p)) & set(map(tuple, z.q)) for z in b)


def test_recall_against_every_window(spark):
    """Edited items of all kinds, held against all windows of an item's size, aligned or not: leaks of 0.8 and more."""
    r = random.Random(12)
    text = lambda n: [f"v{r.randrange(2000)}" for _ in range(n)]
    items = [(k, text(r.randint(15, 59))) for k in range(60)]
    docs = []
    for k in range(600):
        w = list(items[k % 60][1])
        for _ in range(r.choice([0, 1, 1, 1, 2])):
            at = r.randrange(len(w))
            edit = r.choice(["put", "drop", "change", "swap"])
            w[at : at + (edit != "put")] = [] if edit == "drop" else text(1)
            if edit == "swap":
                w = w[at:] + w[:at]
        docs.append((k, text(r.randint(0, 80)) + w + text(r.randint(0, 80))))
    grams = lambda w: Counter(zip(*(w[j:] for j in range(5))))
    true, close = set(), set()
    for i, w in items:
        mine, n = grams(w), len(w) - 4
        for d, v in docs:
            for s in range(max(1, len(v) - len(w) + 1)):
                c = grams(v[s : s + len(w)])
                least = sum((c & mine).values())
                if least >= 0.8 * (n + sum(c.values()) - least):
                    true.add((d, i))
                    if least >= 0.87 * (n + sum(c.values()) - least):
                        close.add((d, i))
    found = decontaminate.leaks(spark.createDataFrame([(d, " ".join(v)) for d, v in docs], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"))
    got = {(x.doc_id, x.item_id) for x in found.collect()}
    assert got <= true and len(true) > 200 and len(got) >= 0.95 * len(true) and len(got & close) >= 0.99 * len(close)


def test_item_longer_than_any_counter(spark):
    long = " ".join(f"v{k % 70001}" for k in range(70_500))
    rows = decontaminate.leaks(spark.createDataFrame([(None, "a b " + long + " c"), (2, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, long)], "item_id long, text string")).collect()
    assert (None, 2, 70_500, 1.0) in [(x.doc_id, x.start, x.words, x.similarity) for x in rows] and {x.doc_id for x in rows} == {None}


def test_near_copies_at_edges_and_in_another_order(spark):
    r = random.Random(6)
    text = lambda n: [f"v{r.randrange(10**6)}" for _ in range(n)]
    w = text(60)
    docs = [
        ("shorter", w[:30] + w[31:]),  # one word deleted, nothing else
        ("end", text(40) + w[:-1]),
        ("begin", w[1:] + text(40)),
        ("swapped", w[30:] + w[:30] + text(50)),
        ("swapped inside", text(50) + w[30:] + w[:30] + text(50)),
        ("swapped at the end", text(50) + w[30:] + w[:30]),
        ("too short", w[:50]),  # 46 of 56 shingles
        ("shorter by a fifth", w[:48]),  # 44 of 56 shingles
        ("half", text(30) + w[:30] + text(30)),
    ]
    df = spark.createDataFrame([(k, " ".join(x)) for k, x in docs], "doc_id string, text string")
    rows = decontaminate.leaks(df, spark.createDataFrame([(1, " ".join(w)), (2, " ".join(text(60)))], "item_id long, text string")).collect()
    assert {x.item_id for x in rows} == {1}
    got = {x.doc_id: (x.start, x.words, round(x.similarity, 9)) for x in sorted(rows, key=lambda x: (x.similarity, -x.start))}
    assert got == {
        "shorter": (0, 59, round(51 / 60, 9)), "end": (39, 60, round(55 / 57, 9)), "begin": (0, 60, round(55 / 57, 9)),
        "swapped": (0, 60, round(52 / 60, 9)), "swapped inside": (50, 60, round(52 / 60, 9)), "swapped at the end": (50, 60, round(52 / 60, 9)),
        "too short": (0, 50, round(46 / 56, 9)),
    }


def test_items_without_an_id_count(spark):
    words = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(1, "before " + " ".join(words) + " after"), (2, "quite another text of some length " * 3), (None, " ".join(words[:40]))], "doc_id long, text string")
    items = spark.createDataFrame([(None, " ".join(words)), (None, " ".join(words)), (None, None), (7, "nothing that anyone has written down here at all"), (None, " ".join(reversed(words)))], "item_id long, text string")
    found = decontaminate.leaks(docs, items).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.item_id, r.start) for r in found if r.similarity == 1.0) == [(False, 1, None, 1), (True, None, None, 0)]
    assert [r.doc_id for r in decontaminate.clean(docs, items).collect()] == [2]

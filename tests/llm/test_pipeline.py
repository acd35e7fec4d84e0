import random

import pytest

import corpus_pipeline as cp


@pytest.fixture(scope="module")
def tables(tmp_path_factory, spark):
    r = random.Random(8)
    words = [f"word{k}" for k in range(4000)]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    text = lambda: "\n".join(line(20) for _ in range(6))
    item, passage = line(40), line(60)
    docs = {k: text() for k in range(600)}
    docs[600] = docs[10]  # exact copy
    docs[601] = docs[11].replace(docs[11].split()[50], "changed", 1)  # near copy
    docs[602] = text() + "\n" + line(5) + " " + item + " " + line(5)
    docs[603], docs[604] = docs[20] + "\n" + passage, text() + "\n" + passage + "\n" + line(9)
    docs[603] = text() + "\n" + passage
    docs[605] = " ".join(w + "***" for w in text().split())
    docs[606], docs[607] = None, ""
    docs[601] = docs[601].replace("\n", " ")  # lines of its own: only the near-duplicate stage may take it
    rows = [(k, t, "en", f"s{k % 3}" if k % 50 else None, len(t or ""), "x") for k, t in docs.items()] + [(None, text(), "en", "s1", 5, "x")]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1) for k in range(0, 580)] + [(605, 0)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, passage


def test_stages(spark, tables):
    folder, docs, passage = tables
    d = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, step in cp.STAGES:
        d = cp.stage(step(spark, d, folder), name)
        assert list(d.columns[:5]) == list(cp.COLUMNS)
        seen.append(({r.doc_id for r in d.select("doc_id").collect()}, d))
    quality, lines, near, leaks, mixed = (s for s, _ in seen)
    clean = set(range(600)) | {None}
    assert quality == clean | {600, 601, 602, 603, 604}
    kept = {r.doc_id: r.text for r in seen[1][1].collect()}
    assert 600 not in lines and clean <= lines and sum(passage in (t or "") for t in kept.values()) == 1 and passage in kept[603]
    assert kept[5] == docs[5] and passage not in kept[604] and len(kept[604].split("\n")) == 7
    assert clean <= near and near == lines - {601}
    assert leaks == near - {602}
    last = seen[4][1]
    taken = {}
    for r in last.groupBy("source").agg({"size": "sum", "target": "max", "source_size": "max"}).collect():
        taken[r.source] = (r["sum(size)"], r["max(target)"])
    assert all(abs(a - b) <= 130 for a, b in taken.values()) and last.groupBy("doc_id", "copy").count().where("count > 1").isEmpty()
    assert mixed <= leaks


def test_empty(spark, tables):
    folder = tables[0]
    d = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, step in cp.STAGES:
        assert step(spark, d, folder).select(*cp.COLUMNS).collect() == []


def test_near_duplicates_share_four_fifths_of_five_words(spark):
    r = random.Random(4)
    rows = []
    for k in range(0, 80, 2):
        w = [f"u{r.randrange(10**6)}" for _ in range(100)]
        v, x = list(w), list(w)
        v[30] = v[60] = "changed"  # 86 of 106 on five words, 89 of 105 on four
        x[20] = x[40] = x[60] = "changed"  # 81 of 111 on five words
        rows += [(k, " ".join(w)), (k + 1, " ".join(v if k < 40 else x))]
    d = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x.doc_id for x in cp.near_duplicates(spark, d, "").collect()}
    assert kept == set(range(0, 40, 2)) | set(range(40, 80))

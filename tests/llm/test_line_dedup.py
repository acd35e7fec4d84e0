import random
from collections import defaultdict

from wayline.llm import line_dedup


def brute(rows):
    """The definition, over all chunks of all texts at once."""
    docs = sorted({(d, t) for d, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    groups = defaultdict(list)
    for d, t in docs:
        lines = t.split("\n")
        ch = line_dedup.chunks_of(t)
        for k, (a, z, _) in enumerate(ch):
            groups["\n".join(lines[a:z])].append((d, t, k))
    gone = defaultdict(set)
    for places in groups.values():
        for d, t, k in places[1:]:
            first, end = line_dedup.chunks_of(t)[k][:2]
            gone[d, t] |= set(range(first, end))
    return [(d, t and "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d, t])) for d, t in rows]


def ranges(text):
    """Chunks by the definition alone: each two neighbour lines with words (but not two long ones), and each long line."""
    lines = text.split("\n")
    full = [k for k, x in enumerate(lines) if x.split()]
    long = {k for k in full if len(lines[k].split()) >= 25}
    return sorted([(a, b + 1) for a, b in zip(full, full[1:]) if not {a, b} <= long] + [(k, k + 1) for k in long])


def test_chunks():
    r = random.Random(2)
    for _ in range(200):
        t = "\n".join(" ".join(["w"] * r.choice([0, 0, 1, 3, 24, 25, 26])) for _ in range(r.randint(0, 9)))
        assert sorted(c[:2] for c in line_dedup.chunks_of(t)) == ranges(t)


def test_very_long_text(spark):
    line = " ".join(f"w{k}" for k in range(30))
    long = "\n".join(f"line {k} has some words" for k in range(60_000))
    out = {x.doc_id: x for x in line_dedup.dedup_lines(spark.createDataFrame([(1, long + "\n" + line), (2, line), (3, long)], "doc_id long, text string")).collect()}
    assert out[1].n_removed == 0 and out[2].text == "" and out[3].n_removed == 60_000


def test_against_definition(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    line = lambda n: " ".join(word() for _ in range(n))
    passages = [[line(r.randint(5, 40)) for _ in range(r.randint(1, 9))] for _ in range(12)]
    rows = []
    for k in range(120):
        lines = [line(r.randint(1, 30)) for _ in range(r.randint(1, 8))]
        for p in r.sample(passages, r.randint(0, 2)):
            at = r.randint(0, len(lines))
            lines[at:at] = p
        rows.append((k, "\n".join(lines)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (3, rows[3][1]), (202, None), (203, ""), (None, "x\ny"), (204, "\n\n\n")]
    df = spark.createDataFrame([(*x, 1, "z") for x in rows], "doc_id long, text string, idx int, thash string")
    out = line_dedup.dedup_lines(df).collect()
    got = sorted(((x.doc_id, x.text) for x in out), key=repr)
    # The order among documents with one id differs only where a text differs; ids here are distinct but for equal rows.
    assert got == sorted(brute(rows), key=repr)
    assert all(x.text == "" for x in out if x.doc_id in (200, 201)) and {x.thash for x in out} == {"z"}
    # A passage of over 50 words goes from all but one document.
    for p in passages:
        if sum(len(x.split()) for x in p) > 50 and any(len(x.split()) >= line_dedup.LONG_LINE for x in p):
            assert sum(p_line in (x.text or "").split("\n") for x in out for p_line in p if len(p_line.split()) >= line_dedup.LONG_LINE and x.doc_id != 3) <= len(p)
    assert line_dedup.dedup_lines(df.limit(0)).collect() == []


def test_passages_of_short_lines_go_whole(spark):
    r = random.Random(11)
    line = lambda n: " ".join("".join(r.choice("abcdefghijkl") for _ in range(5)) for _ in range(n))
    passages = [[line(n) for _ in range(lines)] for lines, n in [(3, 20), (4, 15), (5, 12), (6, 10), (8, 8), (2, 8), (30, 9)] for _ in range(5)]
    rows, own = [], {}
    for d in range(10):
        for k, p in enumerate(passages):
            above, below = [line(9) for _ in range(r.randint(0, 3))], [line(9) for _ in range(r.randint(0, 3))]
            gap = "\n \n" if k % 2 else "\n"
            rows.append((d * 100 + k, "\n".join([*above, gap.join(p), *below])))
            own[d * 100 + k] = [*above, *below]
    rows += [(5000 + k, f"{line(9)}\n\none short line\n\n{line(9)}") for k in range(3)]
    out = {x.doc_id: x.text for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, t in rows:
        assert out[d] == (t if d < 100 or d >= 5000 else "\n".join(own[d]))

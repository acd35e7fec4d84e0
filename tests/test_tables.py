"""Numbers over whole tables, the packed export, the sink of JSON lines, the seeded shuffle."""

import os
import struct

import numpy as np
from pyspark.sql import functions as F

from wayline.operators import numbering, prep
from wayline.sources import packed, sinks


def test_numbers_and_running_totals(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        d = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), (F.col("id") % 5 == 0).cast("long").alias("v"), F.lit("x").alias("other")).repartition(5)
        out = numbering.running(d, ["k"], {"idx": None, "upto": "v"})
        rows = sorted((r.k, r.v, r.idx, r.upto) for r in out.collect())
        total = 0
        for n, (k, v, idx, upto) in enumerate(rows):
            total += v
            assert k == idx == n and upto == total
        assert out.columns == ["k", "v", "other", "idx", "upto"] and numbering.numbered(d.limit(0), ["k"]).collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_packed_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packed, "STRETCH", 10)
    nodes = [(i, i * 1.25 - 3, i * -2.5) for i in range(37)]
    edges = [(i, (i * 7) % 37, 1.5 * i) for i in range(37)] + [(3, 4, 9.25), (3, 4, 9.25)]
    n, e = spark.createDataFrame(nodes, "idx long, x double, y double").repartition(3), spark.createDataFrame(edges, "a long, b long, cost double").repartition(3)
    folder = str(tmp_path / "graph")
    packed.save_packed(packed.pack(n, e, 52.5, -1.25), folder)
    data = b"".join(open(f"{folder}/{f}", "rb").read() for f in sorted(os.listdir(folder)))
    want = struct.pack("<ddI", 52.5, -1.25, 37) + np.array([x[1:] for x in nodes], "<f4").tobytes() + struct.pack("<I", 39) + b"".join(struct.pack("<IIf", *x) for x in sorted(edges))
    assert data == want
    a, b = packed.load_packed(spark, folder)
    assert sorted(map(tuple, a.collect())) == nodes and sorted(map(tuple, b.collect())) == sorted(edges)
    empty = str(tmp_path / "empty")
    packed.save_packed(packed.pack(n.limit(0), e.limit(0), 0.0, 0.0), empty)
    assert b"".join(open(f"{empty}/{f}", "rb").read() for f in sorted(os.listdir(empty))) == struct.pack("<ddII", 0, 0, 0, 0)


def test_a_batch_that_runs_again_replaces_its_lines(spark, tmp_path):
    rows = [(k, f"n{k}") for k in range(30)]
    for part in (rows[:10], rows[10:20], rows[20:]):
        spark.createDataFrame(part, "k long, name string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(checkpoint):
        stream = spark.readStream.schema("k long, name string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        sinks.json_lines(stream, F.struct("k", "name"), str(tmp_path / "out"), str(tmp_path / checkpoint), once=True).awaitTermination()

    run("cp")
    for name in ("2", ".2.crc"):
        os.remove(tmp_path / "cp" / "commits" / name)  # as if it had died before the last commit
    run("cp")
    got = spark.read.json(str(tmp_path / "out")).select("k", "name").collect()
    assert sorted(map(tuple, got)) == rows


def test_the_seeded_shuffle_is_that_of_sorted_names(spark):
    names = [f"drive{k:02d}" for k in range(35)]
    got = {r.grp: r.o for r in prep.shuffled(spark.createDataFrame([(n,) for n in reversed(names)] * 2, "grp string")).collect()}
    want = list(names)
    np.random.default_rng(26168).shuffle(want)
    assert [n for n, _ in sorted(got.items(), key=lambda x: x[1])] == want
    stats = spark.createDataFrame([(f"{n}{p}", 100.0 + k, 5.0) for k, n in enumerate(names) for p in "ab"] + [("short1", 5.0, 9.0)], "sequence_id string, duration_s double, path_km double")
    split = {r.grp: r.split for r in prep.assign_splits(stats.withColumn("grp0", F.lit(1)).drop("grp0"), prep.shuffled(spark.createDataFrame([(n,) for n in names], "grp string"))).collect() if r.grp in names}
    size, total, at = {n: 2 * (100.0 + k) for k, n in enumerate(names)}, 0.0, {}
    for n in want:
        at[n] = total
        total += size[n]
    if split:
        assert split == {n: "train" if at[n] / total < 0.7 else "val" if at[n] / total < 0.85 else "test" for n in split}


def test_quantile_between_two_values_without_a_task_of_all(spark):
    d = spark.range(1000).select((F.col("id") * 7 % 1000 / 4.0).alias("v")).repartition(5)
    got = numbering.quantile(numbering.numbered(d, ["v"]), "v", 0.995).first().v
    assert abs(got - np.quantile(np.arange(1000) / 4.0, 0.995)) < 1e-12
    assert numbering.quantile(numbering.numbered(d.limit(1), ["v"]), "v", 0.5).first().v == d.limit(1).first().v
    assert numbering.quantile(numbering.numbered(d.limit(0), ["v"]), "v", 0.5).first().v is None

import random

from pyspark.sql import functions as F

from wayline.llm.components import components, with_least


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def test_against_union_find(spark):
    r = random.Random(8)
    edges = [(0, k) for k in range(50, 150)] + [(k, 999) for k in range(200, 300)]  # stars around the least and the greatest node
    edges += [(k, k + 1) for k in range(400, 440)] + [(r.randint(500, 700), r.randint(500, 700)) for _ in range(150)] + edges[:5]
    d = spark.createDataFrame(edges, "a long, b long")
    got = {x.node: x.root for x in components(d).collect()}
    assert got == {k: v for k, v in brute([e for e in edges if e[0] != e[1]]).items()}
    assert components(d.limit(0)).collect() == []


def test_edges_of_a_node_with_most_of_them_stay_where_they_are(spark):
    star = spark.range(1, 20_001).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    edges = star.union(spark.range(30_000, 40_000).selectExpr("id as u", "id + 1 as v")).repartition(8, "v")
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    out = with_least(edges, least, 30_000)
    assert out.count() == 30_000 and out.where("u = 0 and m <> 1 or u > 0 and m <> v").count() == 0
    parts = [x["count"] for x in out.where("u = 0").groupBy(F.spark_partition_id()).count().collect()]
    assert max(parts) < 10_000  # not all in one task


def test_few_edges_are_met_without_broadcasts(spark, monkeypatch):
    from wayline.llm import components as module

    def never(*a):
        raise AssertionError("a broadcast for few edges")

    monkeypatch.setattr(module, "with_least", never)
    d = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(90, 91)], "a long, b long")
    assert {x.node: x.root for x in components(d).collect()} == {**{k: 0 for k in range(31)}, 90: 90, 91: 90}
    least = spark.createDataFrame([(1, 0, 1)], "u long, m long, n long")
    plan = module._met(spark.createDataFrame([(1, 0)], "u long, v long"), least, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan

import math
import random

from pyspark.sql import functions as F

from wayline.operators import graph
from wayline.sources import graphs


def test_routes_of_more_than_64_edges(spark):
    edges = [(k, k + 1, 1.0) for k in range(66)] + [(0, 66, 100.0)]
    start = spark.createDataFrame([(1, 0)], "query int, node long")
    found = graph.routes(spark.createDataFrame(edges, "src long, dst long, cost double").coalesce(1), start)
    out = {x.node: x for x in graph.with_paths(found).collect()}
    assert {k: x.cost for k, x in out.items()} == {k: float(k) for k in range(67)} and list(out[66].path) == list(range(67))


def test_a_dense_cell_is_work_for_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(graph, "CELL_ROWS", 32)
    draw = random.Random(1)
    place = lambda dense: (draw.uniform(10, 110), draw.uniform(10, 110)) if dense else (draw.uniform(0, 5000), draw.uniform(0, 5000))
    segments, points = [], []
    for k in range(1000):
        x, y = place(k % 10)
        segments.append((k, x, y, x + 3, y + 4, 0.6))
    for k in range(60):
        points.append((k, *place(k % 3)))
    s, p = spark.createDataFrame(segments, "id long, ax double, ay double, bx double, by double, bearing double"), spark.createDataFrame(points, "point_id long, e double, n double")
    got = sorted(map(tuple, graph.segment_candidates(p, s).select("point_id", "id").collect()))
    assert got == sorted((q, k) for q, e, n in points for k, ax, ay, bx, by, _ in segments if ax - 120 <= e <= bx + 120 and ay - 120 <= n <= by + 120)
    cell = lambda d, x, y: d.withColumns({"cx": F.floor(F.col(x) / 120), "cy": F.floor(F.col(y) / 120)})
    # Rows of both sides by the whole key of the join: 90 % of segments lie in one cell.
    keys = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        joined = graph.join_cells(cell(p, "e", "n").repartition(200), cell(s, "ax", "ay"), "point_id", 32)
        most = joined.groupBy("cx", "cy", F.pmod(F.xxhash64("id"), F.lit(math.ceil(900 / 32)))).agg(F.count_distinct("id").alias("n")).agg(F.max("n")).first()[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", keys)
    assert most <= 50  # under 5 % of 1,000
    nodes = spark.createDataFrame([(k, x, y) for k, x, y, *_ in segments], "id long, x double, y double")
    for r in graph.nearest_node(p, nodes).collect():
        e, n = points[r.point_id][1:]
        assert r.node == min(segments, key=lambda t: (math.dist(t[1:3], (e, n)), t[0]))[0]


def test_a_bounded_read_leaves_tiles_alone(spark, tmp_path):
    rows = [(k, 500.0 * k, 100.0, 500.0 * k + 450, 120.0, 1.5) for k in range(100)]
    s = spark.createDataFrame(rows, "id long, ax double, ay double, bx double, by double, bearing double")
    none = spark.createDataFrame([], "id long, x double, y double")
    folder = f"file://{tmp_path}/graph"
    graphs.write_graph(none, spark.createDataFrame([], "src long, dst long, cost double"), s, 52.0, -1.0, folder)
    some = graphs.read_segments(spark, folder, 52.0, -1.0, (10_200.0, 11_300.0, 0.0, 200.0))
    assert sorted(r.id for r in some.collect()) == [20, 21, 22] and graphs.read_segments(spark, folder, 52.0, -1.0).count() == 100
    whole = graphs.read_segments(spark, folder, 52.0, -1.0)
    read = lambda d: d.select(F.input_file_name()).distinct().count()
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tx" in plan and read(some) <= 4 < read(whole)


def test_points_and_nodes_of_a_cell_are_not_paired_as_rows(spark, monkeypatch):
    rows, own = [], graph.join_cells
    monkeypatch.setattr(graph, "join_cells", lambda *a: rows.append(own(*a)) or rows[-1])
    p = spark.range(200).selectExpr("id as point_id", "id * 1.0 as e", "id % 7 * 1.0 as n")
    nodes = spark.range(50).selectExpr("id", "id * 4.0 as x", "3.0 as y")
    got = {r.point_id: r.node for r in graph.nearest_node(p, nodes).collect()}
    assert got == {k: min(range(50), key=lambda v: (abs(v * 4 - k) ** 2 + (k % 7 - 3) ** 2, v)) for k in range(200)}
    assert sum(d.count() for d in rows) == 200


def test_whole_paths_of_few_nodes_pass_between_rounds(spark, monkeypatch):
    sizes, own = [], graph.written

    def counted(d, name):
        d = own(d, name)
        sizes.append(d.selectExpr("sum(size(path))").first()[0] or 0)
        return d

    monkeypatch.setattr(graph, "written", counted)
    monkeypatch.setattr(graph, "EVERY", 16)
    n = 500
    found = spark.range(n).selectExpr("1 as query", "id as node", "id * 1.0 as cost", "nullif(id - 1, -1) as prev")
    assert {r.node: r.path for r in graph.with_paths(found).collect()} == {k: list(range(k + 1)) for k in range(n)}
    assert max(sizes) < n * n / 2 / 5


def test_points_of_ways_are_made_from_stretches_that_ways_share(spark, monkeypatch):
    for name, value in (("LEAP", 6), ("TILE", 8), ("RUN", 4), ("FEW", 2), ("TASK_ROWS", 500)):
        monkeypatch.setattr(graph, name, value)
    draw, prev = random.Random(2), {0: None}
    for k in range(1, 240):  # a tree of long ways, and one node with many behind it
        prev[k] = 7 if k % 4 == 0 and k > 7 else draw.randint(max(0, k - 3), k - 1)
    way = lambda prev, k: [] if k is None else [*way(prev, prev[k]), k]
    trees = {1: prev, 2: {k: k - 1 if k else None for k in range(90)}, 3: {5: None}}
    rows = [(q, k, p, f"at {k}") for q, t in trees.items() for k, p in t.items()]
    found = spark.createDataFrame(rows, "query int, node long, prev long, name string")
    points = graph.way_points(found, F.struct("name"))
    got = sorted((r.query, r.node, r.step, r.item.name) for r in points.collect())
    assert got == sorted((q, k, i, f"at {v}") for q, t in trees.items() for k in t for i, v in enumerate(way(t, k)))
    assert points.rdd.getNumPartitions() == math.ceil(len(got) / 500)
    assert graph.way_points(found.limit(0), F.struct("name")).count() == 0


def test_g03_writes_no_whole_ways(spark, monkeypatch, tmp_path):
    from wayline.plans import other_queries

    n, sizes, own = 1500, [], graph.written

    def counted(d, name):
        d = own(d, name)
        sizes.append(d.selectExpr("sum(size(path))").first()[0] if "path" in d.columns else 0)
        return d

    monkeypatch.setattr(graph, "written", counted)
    spark.range(n).selectExpr("id as s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(1).selectExpr("id as c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    points = other_queries.g03(spark, str(tmp_path))
    assert max(sizes) <= 25 * 2 * n  # so many points for each of 2 * n ways, however long they are
    far = lambda q: f"abs(node % 10 - {q % 10}) + abs(node div 10 - {q // 10})"
    steps = points.groupBy("query", "node").agg(F.count("*").alias("n"), F.count_distinct("step").alias("d"), F.min("step").alias("lo"), F.max("step").alias("hi"))
    steps = steps.withColumn("far", F.expr(f"case query when 12 then {far(12)} else {far(55)} end"))
    assert steps.count() == 2 * n and steps.where("n <> far + 1 or d <> n or lo <> 0 or hi <> far").isEmpty()

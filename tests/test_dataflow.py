"""Generic operators, scalar expressions and ordering on small frames."""

from pyspark.sql import functions as F

from weftgraph.functions.ordering import numbered
from weftgraph.functions.scalars import appended, last_of, shard_of, sink_line, surviving
from weftgraph.operators.dataflow import Flow, resource_allocation, shortest_paths, visited_expand


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_scalars(spark):
    df = spark.createDataFrame([(7, 12, [1, 2, 3], [2, 3, 9])], "b0 long, b1 long, qs array<int>, ok array<int>")
    r = df.select(shard_of(["b0", "b1"], 5).alias("s"), surviving("qs", "ok").alias("left"), appended("qs", F.lit(4)).alias("more"), last_of("qs").alias("last"), sink_line(["b0", "qs", "b1"], "qs").alias("line")).first()
    assert (r.s, r.left, r.more, r["last"], r.line) == (2, [2, 3], [1, 2, 3, 4], 3, "7 --Query: 1 2 3 -- 12")


def test_numbered(spark):
    df = spark.createDataFrame([(d, x) for d in (3, 1, 2) for x in (5, 4)], "day int, x int").repartition(5)
    assert rows(numbered(df, "day", ["x"])) == [(1, 4, 1), (1, 5, 2), (2, 4, 3), (2, 5, 4), (3, 4, 5), (3, 5, 6)]
    assert rows(numbered(df.limit(0), "day", ["x"])) == []


def test_flow(spark):
    f = Flow(spark.createDataFrame([(1, [1, 2]), (2, [])], "id long, xs array<int>"))
    assert rows(f.flat_map(F.col("xs"), "x").map("id", "x").df) == [(1, 1), (1, 2)]
    assert f.flat_map(F.col("xs"), "x", optional=True).df.count() == 3
    assert rows(f.filter("id = 2").union(f.node_by_id(1)).map("id").df) == [(1,), (2,)]
    assert f.limit(1).df.count() == 1 and rows(f.map("id").top(1, F.desc("id")).df) == [(2,)]
    assert rows(f.map("id").map_partition(lambda b: (x.assign(id=x.id * 2) for x in b), "id long").rename(id="twice").df) == [(2,), (4,)]
    assert rows(f.map("id").shuffle("id", shards=3).barrier().reduce([], F.sum("id").alias("n")).df) == [(3,)]


def test_traversals(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 9)], "src long, dst long")
    start = Flow(spark.createDataFrame([(3,), (4,)], "v long"))
    assert rows(start.expand(e, "v", "w").df) == [(3, 1), (3, 4)]
    assert rows(start.expand(e, "v", "w", optional=True).df.na.fill(0)) == [(3, 1), (3, 4), (4, 0)]
    assert rows(start.expand(e, "v", "w", direction="in").expand_into(e, "w", "v").df) == [(2, 3), (3, 4)]
    assert rows(visited_expand(e, spark.createDataFrame([(1,)], "id long"))) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert rows(visited_expand(e, spark.createDataFrame([(1,)], "id long"), hops=1)) == [(1, 0), (2, 1)]
    w = spark.createDataFrame([(1, 2, 5.0), (1, 3, 1.0), (3, 2, 1.0)], "src long, dst long, w double")
    assert rows(shortest_paths(w, 1, "w")) == [(1, 0.0), (2, 2.0), (3, 1.0)]
    both = spark.createDataFrame([(1, 3), (3, 1), (2, 3), (3, 2), (3, 4), (4, 3)], "src long, dst long")
    assert rows(resource_allocation(both, spark.createDataFrame([(1, 2), (1, 3)], "a long, b long"))) == [(1, 2, 1 / 3), (1, 3, 0.0)]


def test_projections(spark):
    f = Flow(spark.createDataFrame([(1, 2), (5, 6)], "a long, b long"))
    nodes = spark.createDataFrame([(1, "x")], "id long, name string")
    edges = spark.createDataFrame([(5, 6, 0.5)], "src long, dst long, w double")
    assert rows(f.project_node(nodes, "a", "name").map("a", "name").df.na.fill("")) == [(1, "x"), (5, "")]
    assert rows(f.project_edge(edges, "a", "b", "w").map("a", "w").df.na.fill(0.0)) == [(1, 0.0), (5, 0.5)]

"""Registered queries of the graph engine over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.lineage import shared_dir
from weftgraph.functions.scalars import shard_of, sink_line
from weftgraph.operators.dataflow import Flow, resource_allocation, shortest_paths, visited_expand
from weftgraph.operators.delta import DeltaEngine
from weftgraph.operators.graph import NEVER, Graph
from weftgraph.operators.match import match, match_counts
from weftgraph.plans.pattern import Pattern, edge_types, instances
from weftgraph.plans.stats import Degrees, edge_statistics
from weftgraph.sources.relational import (
    BY_CUSTOMER, CUSTOMER, CUSTOMER_NATION, HAS_PART, HAS_SUPPLIER, NATION, ORDER, PART, PART_SUPPLIER, PEERS, STRIDE, SUPPLIER, SUPPLIER_NATION, SYMMETRIC, Tables, relational_graph,
)
from weftgraph.streaming.engine import StreamEngine, running_counts

#: The registered patterns over the relational graph.
PATTERNS = [
    Pattern.of("edge1", [ORDER, PART], [(0, 1, HAS_PART)], SYMMETRIC),
    Pattern.of("order_part_order", [ORDER, PART, ORDER], [(0, 1, HAS_PART), (2, 1, HAS_PART)], SYMMETRIC),
    Pattern.of("triangle", [ORDER, PART, SUPPLIER], [(0, 1, HAS_PART), (0, 2, HAS_SUPPLIER), (1, 2, PART_SUPPLIER)], SYMMETRIC),
    Pattern.of("square_customer", [ORDER, PART, ORDER, CUSTOMER], [(0, 1, HAS_PART), (2, 1, HAS_PART), (0, 3, BY_CUSTOMER), (2, 3, BY_CUSTOMER)], SYMMETRIC),
    Pattern.of("peer_wedge", [SUPPLIER, ORDER, CUSTOMER, CUSTOMER], [(1, 0, HAS_SUPPLIER), (1, 2, BY_CUSTOMER), (2, 3, PEERS)], SYMMETRIC),
    Pattern.of("local_supply", [ORDER, SUPPLIER, CUSTOMER, NATION], [(0, 1, HAS_SUPPLIER), (1, 3, SUPPLIER_NATION), (0, 2, BY_CUSTOMER), (2, 3, CUSTOMER_NATION)], SYMMETRIC),
    Pattern.of("part_to_nation", [ORDER, PART, CUSTOMER, NATION], [(0, 1, HAS_PART), (0, 2, BY_CUSTOMER), (2, 3, CUSTOMER_NATION)], SYMMETRIC),
    Pattern.of("triangle_customer", [ORDER, PART, SUPPLIER, CUSTOMER], [(0, 1, HAS_PART), (0, 2, HAS_SUPPLIER), (1, 2, PART_SUPPLIER), (0, 3, BY_CUSTOMER)], SYMMETRIC),
]
PATH2 = Pattern.of("path2", [ORDER, CUSTOMER, NATION], [(0, 1, BY_CUSTOMER), (1, 2, CUSTOMER_NATION)], SYMMETRIC)
TRIANGLE = PATTERNS[2]
BATCH = 1000
#: Update files, and so micro-batches, of the streaming query.
STREAM_BATCHES = 4
#: In the query with deletions, every 5th update's edge ends this many updates later.
DELETE_EVERY, DELETE_AFTER = 5, 500
#: In the query with vertex deletions, customers with such keys go.
DROP_EVERY = 7

_graphs: dict[tuple[str, str], Graph] = {}


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The settled relational graph, built once per application and folder: the loaded state that queries run on."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _graphs:
        _graphs[key] = relational_graph(spark, sf_dir).settled()
    return _graphs[key]


def _query(patterns: list[Pattern], *names: str) -> list[Pattern]:
    return [p for p in patterns if p.name in names]


def _delta(*names: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return DeltaEngine(graph(spark, sf_dir), _query(PATTERNS, *names)).counts()

    return run


def graph_edges_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).edges.groupBy("label").agg(F.count(F.lit(1)).alias("n_edges"), F.sum((F.col("seq") > 0).cast("long")).alias("n_stream"))


def graph_vertices_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).vertices.groupBy("label").agg(F.count(F.lit(1)).alias("n_vertices"))


def graph_degree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_statistics(graph(spark, sf_dir).edges).select("label", F.col("edges").alias("n_edges"), F.round("mean_out", 6).alias("mean_out"), F.round("mean_in", 6).alias("mean_in"))


def scan_updates_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates joined to the distinct edge types of the patterns (a bounded, broadcast table)."""
    types = spark.createDataFrame([(i, *t) for i, t in enumerate(edge_types(PATTERNS))], "edge_type int, src_label int, dst_label int, label int")
    updates = graph(spark, sf_dir).edges.where("seq > 0")
    return updates.join(F.broadcast(types), ["src_label", "dst_label", "label"]).select("seq", "edge_type", "src", "dst")


def update_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).edges.where(F.col("seq").between(101, 300)).select("seq", "src", "dst", "label")


def root_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(q, *t, a, b) for t, found in instances(PATTERNS).items() for q, a, b in found]
    return spark.createDataFrame(rows, "query_id int, src_label int, dst_label int, edge_label int, src_var int, dst_var int")


def neighbour_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    suppliers = g.vertices.where(F.col("label") == SUPPLIER)
    found = g.neighbours(suppliers, HAS_SUPPLIER, "in")
    return found.groupBy(F.col("id").alias("supplier")).agg(F.count(F.lit(1)).alias("n_orders"))


def match_path2_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match(graph(spark, sf_dir), PATH2)


def match_triangle_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_counts(graph(spark, sf_dir), [TRIANGLE])


def match_triangle_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triangle's bindings by intersecting adjacency arrays."""
    found = match(graph(spark, sf_dir), TRIANGLE, proposer="intersect")
    return found.groupBy(F.col("b2").alias("supplier")).agg(F.count(F.lit(1)).alias("n"))


def delta_homo_vs_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p = graph(spark, sf_dir), _query(PATTERNS, "order_part_order", "square_customer")
    out = None
    for mode, homomorphic in (("iso", False), ("homo", True)):
        one = DeltaEngine(g, p, homomorphic).counts().select(F.lit(mode).alias("mode"), "query_id", "delta_count")
        out = one if out is None else out.unionByName(one)
    return out


def delta_counts_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DeltaEngine(graph(spark, sf_dir), PATTERNS).counts_by_batch(BATCH)


def running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running_counts(delta_counts_by_batch(spark, sf_dir))


def _with_deletes(g: Graph) -> Graph:
    """Times are doubled, so that an end (odd) never shares its time with an insertion (even)."""
    ends = F.when((F.col("seq") > 0) & (F.col("seq") % DELETE_EVERY == 0), 2 * (F.col("seq") + DELETE_AFTER) + 1).otherwise(F.lit(NEVER))
    return replace(g, edges=g.edges.select("src", "dst", "label", "src_label", "dst_label", (2 * F.col("seq")).alias("seq"), ends.alias("del_seq")))


def signed_delta_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per batch of 2000 times: embeddings made minus embeddings ended."""
    return DeltaEngine(_with_deletes(graph(spark, sf_dir)), PATTERNS[:5], deletes=True).counts_by_batch(2 * BATCH)


def vertex_tombstone_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are deleted by an update stream; their edges go with them; recount."""
    g = graph(spark, sf_dir)
    own = g.edges.where(F.col("label").isin(BY_CUSTOMER, CUSTOMER_NATION, PEERS))
    gone = Tables(spark, sf_dir)["customer"].where(F.col("c_custkey") % DROP_EVERY == 0)
    updates = gone.select(
        F.col("c_custkey").cast("long").alias("seq"), F.lit("v").alias("kind"), F.lit(-1).alias("op"),
        (F.lit(CUSTOMER * STRIDE).cast("long") + F.col("c_custkey")).alias("id1"), F.lit(None).cast("long").alias("id2"), F.lit(CUSTOMER).alias("label"),
    ).where("seq > 0")
    after = Graph.of(g.vertices.select("id", "label"), own.select("src", "dst", "label"), updates, SYMMETRIC).at(STRIDE)
    return after.edges.groupBy("label").agg(F.count(F.lit(1)).alias("n_edges"))


def shared_plan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return DeltaEngine(g, PATTERNS, degrees=Degrees.of(g.edges), share=True).counts()


def unshared_plan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return DeltaEngine(g, PATTERNS, degrees=Degrees.of(g.edges), share=False).counts()


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DeltaEngine(graph(spark, sf_dir), [TRIANGLE]).embeddings(0).select("seq", "b0", "b1", "b2")


def sink_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings written to a text sink, one file per partition, and read back."""
    path = f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}"
    rows = embedding_rows(spark, sf_dir).withColumn("queries", F.array(F.lit(0)))
    rows.select(sink_line(["seq", "queries", "b0", "b1", "b2"], "queries").alias("value")).write.mode("overwrite").text(path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured Streaming over ordered update files, a batch each; totals per pattern."""
    g = graph(spark, sf_dir)
    home = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    picked = [BY_CUSTOMER, HAS_PART, HAS_SUPPLIER, PART_SUPPLIER]
    fixed = g.edges.where(F.col("label").isin(*picked) & (F.col("seq") == 0))
    updates = g.edges.where(F.col("label").isin(*picked) & (F.col("seq") > 0)).select("seq", F.lit("e").alias("kind"), F.lit(1).alias("op"), F.col("src").alias("id1"), F.col("dst").alias("id2"), "label")
    last = updates.agg(F.max("seq")).first()[0] or 0
    for k in range(STREAM_BATCHES):  # the files' times give their order
        part = updates.where((F.col("seq") > k * last // STREAM_BATCHES) & (F.col("seq") <= (k + 1) * last // STREAM_BATCHES))
        part.coalesce(1).write.mode("append").parquet(f"{home}/updates")
    engine = StreamEngine(spark, home, _query(PATTERNS, "order_part_order", "triangle"), symmetric=SYMMETRIC)
    engine.start_from(g.vertices.select("id", "label"), fixed.select("src", "dst", "label"))
    source = spark.readStream.schema(updates.schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/updates")
    engine.stream(source, f"{home}/checkpoint").awaitTermination()
    return engine.totals()


def topk_hot_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten parts with most new triangles (ties by id)."""
    return Flow(embedding_rows(spark, sf_dir)).reduce(["b1"], F.count(F.lit(1)).alias("n_new")).top(10, F.desc("n_new"), F.asc("b1")).rename(b1="part").df


def expand_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    customers = Flow(g.vertices.where(F.col("label") == CUSTOMER).select(F.col("id").alias("customer")))
    return customers.expand(g.edges, "customer", "order", BY_CUSTOMER, "in", optional=True).reduce(["customer"], F.count("order").alias("n_orders")).df


def expand_into(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-part pairs of the stream whose order also has a supplier of the part."""
    g = graph(spark, sf_dir)
    pairs = Flow(g.edges.where((F.col("label") == HAS_PART) & (F.col("seq") > 0)).select(F.col("src").alias("o"), F.col("dst").alias("p")))
    return pairs.expand(g.edges, "o", "s", HAS_SUPPLIER).expand_into(g.edges, "p", "s", PART_SUPPLIER).reduce(["p"], F.count(F.lit(1)).alias("n")).df


def _first_peer(g: Graph) -> DataFrame:
    return g.edges.where(F.col("label") == PEERS).agg(F.min("src").alias("id"))


def visited_expand_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return visited_expand(g.edges.where(F.col("label") == PEERS), _first_peer(g))


def sssp(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    start = _first_peer(g).first()[0]
    found = shortest_paths(g.edges.where(F.col("label") == PEERS), start)
    return found.select("id", F.col("distance").cast("long").alias("distance"))


def resource_allocation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = graph(spark, sf_dir).edges.where(F.col("label") == PEERS)
    pairs = e.where(F.col("src") < F.col("dst")).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return resource_allocation(e, pairs).select("a", "b", F.round("score", 6).alias("score"))


def project_node_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand of the parts in new triangles."""
    parts = Tables(spark, sf_dir)["part"].select((F.lit(PART * STRIDE).cast("long") + F.col("p_partkey")).alias("id"), "p_brand")
    return Flow(embedding_rows(spark, sf_dir)).project_node(parts, "b1", "p_brand").reduce(["p_brand"], F.count(F.lit(1)).alias("n_new")).df


def project_edge_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity on the order-part edges of new triangles."""
    lines = Tables(spark, sf_dir)["lineitem"].groupBy((F.lit(ORDER * STRIDE).cast("long") + F.col("l_orderkey")).alias("src"), (F.lit(PART * STRIDE).cast("long") + F.col("l_partkey")).alias("dst")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("quantity"))
    return Flow(embedding_rows(spark, sf_dir)).project_edge(lines, "b0", "b1", "quantity").reduce(["b2"], F.sum("quantity").cast("double").alias("quantity")).rename(b2="supplier").df


def node_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Flow(graph(spark, sf_dir).vertices.select("id", "label")).node_by_id(CUSTOMER * STRIDE + 1).df


def map_partition_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Flow(graph(spark, sf_dir).edges.where("seq > 0").select("label", "seq"))
    return rows.map_partition(lambda batches: batches, "label int, seq long").reduce(["label"], F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq")).df


def flat_map_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ends of every update edge, counted by label."""
    rows = Flow(graph(spark, sf_dir).edges.where("seq > 0").select("src", "dst"))
    return rows.flat_map(F.array("src", "dst"), "id").reduce(["id"], F.count(F.lit(1)).alias("n")).filter("n >= 20").df


def shuffle_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Flow(graph(spark, sf_dir).edges.where("seq > 0").select("src", "dst"))
    keyed = rows.map("src", "dst", shard_of(["src", "dst"], 8).alias("shard"))
    return keyed.shuffle("dst", shards=8).barrier().reduce(["shard"], F.count(F.lit(1)).alias("n")).df


def loop_unrolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peers of peers of peers of a customer, with multiplicity, by an unrolled loop."""
    g = graph(spark, sf_dir)
    e = g.edges.where(F.col("label") == PEERS)
    start = Flow(_first_peer(g).select(F.col("id").alias("at"), F.lit(1).cast("long").alias("paths")))

    def step(f: Flow) -> Flow:
        return f.expand(e, "at", "to").reduce(["to"], F.sum("paths").alias("paths")).rename(to="at")

    return start.loop(3, step).df


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "graph_edges_by_label": graph_edges_by_label,
        "graph_vertices_by_label": graph_vertices_by_label,
        "graph_degree_stats": graph_degree_stats,
        "scan_updates_typed": scan_updates_typed,
        "update_range": update_range,
        "root_instances": root_instances,
        "neighbour_scan": neighbour_scan,
        "match_path2_static": match_path2_static,
        "match_triangle_static": match_triangle_static,
        "match_triangle_intersect": match_triangle_intersect,
        "delta_edge1": _delta("edge1"),
        "delta_path_order_part_order": _delta("order_part_order"),
        "delta_triangle": _delta("triangle"),
        "delta_square_cust": _delta("square_customer"),
        "delta_sym_wedge": _delta("peer_wedge"),
        "delta_local_supply": _delta("local_supply"),
        "delta_homo_vs_iso": delta_homo_vs_iso,
        "delta_counts_by_batch": delta_counts_by_batch,
        "running_counts": running,
        "signed_delta_deletes": signed_delta_deletes,
        "vertex_tombstone_cascade": vertex_tombstone_cascade,
        "shared_plan_counts": shared_plan_counts,
        "unshared_plan_counts": unshared_plan_counts,
        "embedding_rows": embedding_rows,
        "sink_lines": sink_lines,
        "stream_counts": stream_counts,
        "topk_hot_vertices": topk_hot_vertices,
        "expand_optional": expand_optional,
        "expand_into": expand_into,
        "visited_expand_bfs": visited_expand_bfs,
        "sssp": sssp,
        "resource_allocation_index": resource_allocation_index,
        "project_node_props": project_node_props,
        "project_edge_props": project_edge_props,
        "node_by_id": node_by_id,
        "map_partition_rows": map_partition_rows,
        "flat_map_rows": flat_map_rows,
        "shuffle_barrier": shuffle_barrier,
        "loop_unrolled": loop_unrolled,
    }

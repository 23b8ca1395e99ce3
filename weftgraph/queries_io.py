"""Registered queries of sources, sinks and state: what is written in a text format or a state folder is read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.lineage import shared_dir
from weftgraph.functions.scalars import appended, last_of, surviving
from weftgraph.operators.dataflow import Flow
from weftgraph.operators.graph import Graph
from weftgraph.plans.pattern import edge_types, instances
from weftgraph.queries import PATTERNS, graph
from weftgraph.sources.relational import BY_CUSTOMER, CUSTOMER, CUSTOMER_NATION, STRIDE, SYMMETRIC
from weftgraph.sources.text import graph_lines, pattern_text, read_edges, read_patterns, read_updates, read_vertices, update_line
from weftgraph.streaming.engine import StreamEngine

#: Text files that the update stream is written to, in order.
STREAM_FILES = 8
#: Patterns that the survival query keeps.
KEPT = [0, 2, 5]
#: Labels that re-inserted and refused vertices are given.
REVIVED, REFUSED = 98, 99


def _home(spark: SparkSession, stem: str) -> str:
    return f"{shared_dir(spark)}/{stem}-{uuid.uuid4().hex}"


def read_text_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole graph as text lines, read back: kind, label, rows."""
    g, path = graph(spark, sf_dir), _home(spark, "text")
    graph_lines(g.vertices.select("id", "label"), g.edges.select("src", "dst", "label")).write.text(path)
    v = read_vertices(spark, path).groupBy("label").agg(F.count_distinct("id").alias("n")).select(F.lit("vertex").alias("kind"), "label", "n")
    return v.unionByName(read_edges(spark, path).groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), "label", "n"))


def read_update_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All updates as ordered text files, read back with their line numbers."""
    path = _home(spark, "updates")
    updates = graph(spark, sf_dir).edges.where("seq > 0").select("seq", F.lit("e").alias("kind"), F.lit(1).alias("op"), F.col("src").alias("id1"), F.col("dst").alias("id2"), "label")
    updates.repartitionByRange(STREAM_FILES, "seq").sortWithinPartitions("seq").select(update_line().alias("value")).write.text(path)
    return read_updates(spark, path)


def read_pattern_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patterns as files of a folder, read back: query_id, edge_pos, src_var, dst_var, src_label, dst_label, edge_label."""
    path = _home(spark, "patterns")
    for i, p in enumerate(PATTERNS):
        spark.createDataFrame([(line,) for line in pattern_text(p).splitlines()], "value string").coalesce(1).write.text(f"{path}/p{i}")
    rows = [(q, k, e.src, e.dst, *p.edge_type(e)) for q, p in enumerate(read_patterns(spark, path, SYMMETRIC)) for k, e in enumerate(p.edges)]
    return spark.createDataFrame(rows, "query_id int, edge_pos int, src_var int, dst_var int, src_label int, dst_label int, edge_label int")


def first_label_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third customer is inserted again with another label, deleted, and inserted anew: label, vertices."""
    g = graph(spark, sf_dir)
    key = F.col("id") - CUSTOMER * STRIDE
    some = g.vertices.where((F.col("label") == CUSTOMER) & (key % 3 == 0) & (key > 0)).select("id", key.alias("key"))
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(op).alias("op"), F.lit(label).alias("label")) for i, (op, label) in enumerate(((1, REFUSED), (-1, REFUSED), (1, REVIVED)))))
    updates = some.withColumn("s", F.explode(steps)).select(
        (3 * F.col("key") + F.col("s.i")).alias("seq"), F.lit("v").alias("kind"), F.col("s.op").alias("op"), F.col("id").alias("id1"), F.lit(None).cast("long").alias("id2"), F.col("s.label").alias("label")
    )
    edges = g.edges.where(F.col("label").isin(BY_CUSTOMER, CUSTOMER_NATION)).select("src", "dst", "label")
    after = Graph.of(g.vertices.select("id", "label"), edges, updates, SYMMETRIC).at(4 * STRIDE)
    return after.vertices.groupBy("label").agg(F.count(F.lit(1)).alias("n_vertices"))


def late_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of all updates, then batches of what is late and of nothing: batch_id, accepted."""
    g = graph(spark, sf_dir)
    updates = g.edges.where("seq > 0").select("seq", F.lit("e").alias("kind"), F.lit(1).alias("op"), F.col("src").alias("id1"), F.col("dst").alias("id2"), "label")
    engine = StreamEngine(spark, _home(spark, "late"), PATTERNS[:1], symmetric=SYMMETRIC)
    engine.start_from(g.vertices.select("id", "label"), g.edges.where("seq = 0").select("src", "dst", "label"))
    out = []
    for batch, some in enumerate((updates, updates.where("seq <= 1000"), updates.where("seq < 0"))):
        try:
            engine.process(some, batch)
            out.append((batch, True))
        except ValueError:
            out.append((batch, False))
    return spark.createDataFrame(out, "batch_id int, accepted boolean")


def surviving_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates with those of the kept patterns that have an edge of their type: seq, queries, last (vertex bound last)."""
    by_type = {t: sorted({q for q, _, _ in found}) for t, found in instances(PATTERNS).items()}
    types = spark.createDataFrame([(*t, by_type[t]) for t in edge_types(PATTERNS)], "src_label int, dst_label int, label int, queries array<int>")
    rows = graph(spark, sf_dir).edges.where("seq > 0").join(F.broadcast(types), ["src_label", "dst_label", "label"])
    bound = rows.withColumn("kept", F.array(*map(F.lit, KEPT))).withColumn("bound", F.array("src")).withColumn("bound", appended("bound", F.col("dst")))
    left = bound.withColumn("queries", surviving("queries", "kept")).where(F.size("queries") > 0)
    return left.select("seq", F.array_join(F.col("queries").cast("array<string>"), " ").alias("queries"), last_of("bound").alias("last"))


def limit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Flow(graph(spark, sf_dir).edges).limit(100).reduce([], F.count(F.lit(1)).alias("n")).df


def send_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label counts of two jobs that run at once, sent back to the driver and joined there."""
    g = graph(spark, sf_dir)
    jobs = [Flow(g.edges.where(f"seq {op} 0")).reduce(["label"], F.count(F.lit(1)).alias("n")).send_back() for op in ("=", ">")]
    rows = [(i, r["label"], r["n"]) for i, job in enumerate(jobs) for r in job.result()]
    return spark.createDataFrame(rows, "streamed int, label int, n long")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (read_text_graph, read_update_stream, read_pattern_folder, first_label_wins, late_updates, surviving_queries, limit_rows, send_back)
    return {f.__name__: f for f in own}

"""Command line: counts of new embeddings per pattern over an update stream.

python -m weftgraph -v VERTICES -e EDGES -q PATTERN_FOLDER -u UPDATES [-batch 1000] [-iters 10] [-core 1] [-show true] [-out FOLDER]
"""

from __future__ import annotations

import argparse
import uuid

from pyspark.sql import DataFrame, SparkSession

from weftgraph.functions.lineage import shared_dir
from weftgraph.operators.delta import DeltaEngine
from weftgraph.operators.graph import Graph
from weftgraph.sources.text import load_patterns, read_edges, read_updates, read_vertices
from weftgraph.streaming.engine import StreamEngine


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="weftgraph", description=__doc__)
    p.add_argument("-v", required=True, help="vertex file")
    p.add_argument("-e", required=True, help="edge file")
    p.add_argument("-q", required=True, help="folder of pattern files")
    p.add_argument("-u", required=True, help="update stream file")
    p.add_argument("-core", type=int, default=None, help="shuffle partitions")
    p.add_argument("-batch", type=int, default=1000, help="updates per batch")
    p.add_argument("-iters", type=int, default=10, help="most batches")
    p.add_argument("-show", default="false", choices=["true", "false"], help="print counts per pattern")
    p.add_argument("-explain", default="false", choices=["true", "false"], help="print the shared plan")
    p.add_argument("-out", default=None, help="folder of the state and counts (default: a new one in the shared folder)")
    return p.parse_args(argv)


def run(spark: SparkSession, a: argparse.Namespace) -> tuple[StreamEngine, DataFrame]:
    """The engine after its batches, and its totals: query_id, total."""
    if a.core:
        spark.conf.set("spark.sql.shuffle.partitions", a.core)
    patterns = load_patterns(a.q)
    # either file may hold lines of both kinds
    vertices, edges = read_vertices(spark, [a.v, a.e]), read_edges(spark, [a.v, a.e])
    if a.explain == "true":
        print(DeltaEngine(Graph.of(vertices, edges), patterns).explain())
    engine = StreamEngine(spark, a.out or f"{shared_dir(spark)}/run-{uuid.uuid4().hex}", patterns)
    engine.start_from(vertices, edges)
    engine.run(read_updates(spark, a.u), a.batch, a.iters)
    return engine, engine.totals()


def main(argv: list[str] | None = None) -> None:
    a = arguments(argv)
    spark = SparkSession.builder.appName("weftgraph").getOrCreate()
    engine, totals = run(spark, a)
    if a.show == "true":
        for r in totals.orderBy("query_id").collect():
            print(f"{engine.patterns[r['query_id']].name}: {r['total']}")
    for m in engine.metrics:
        print(f"batch {m.batch_id}: {m.updates} updates, update {m.update_ms:.0f} ms, query {m.query_ms:.0f} ms")
    total = sum(m.update_ms + m.query_ms for m in engine.metrics)
    print(f"total {total:.0f} ms, mean {total / max(1, len(engine.metrics)):.0f} ms per batch")


if __name__ == "__main__":
    main()

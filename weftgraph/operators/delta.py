"""Incremental results: signed changes of every pattern's embeddings.

An embedding lives from its newest edge's insertion to its first edge's end. Insertions: each pattern
edge in turn is the root, bound to an edge inserted in the window, and all others are strictly
older, so an embedding is found once, by its newest edge. Ends likewise by the first edge to end.
Several edges end at once when a vertex is deleted (and, for homomorphisms, one data edge may stand
for several pattern edges), so there the first pattern position among equals is the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.graph import Graph
from weftgraph.operators.match import Matcher, with_zeros
from weftgraph.plans.pattern import Pattern
from weftgraph.plans.planner import Plan
from weftgraph.plans.stats import Degrees


def batch_of(seq: Column, batch_size: int) -> Column:
    """Number of the batch of an update, from 0."""
    return F.floor((seq - 1) / batch_size).cast("long")


class DeltaEngine:
    """Deltas of a set of patterns over a graph with updates."""

    def __init__(self, graph: Graph, patterns: list[Pattern], homomorphic: bool = False, share: bool = True, deletes: bool = False, degrees: Degrees | None = None, proposer: str = "join", persist: bool = True):
        self.graph, self.patterns, self.homomorphic, self.deletes = graph, patterns, homomorphic, deletes
        self.proposer, self.persist = proposer, persist
        degrees = degrees or graph.degrees()
        self.plan = Plan(patterns, degrees, ties=homomorphic, share=share)
        self.end_plan = Plan(patterns, degrees, ties=True, share=share) if deletes else None

    def _matchers(self, window: tuple[int, int] | None, persist: bool) -> list[tuple[int, Matcher]]:
        out = [(1, Matcher(self.graph, self.plan, "insert", self.homomorphic, window, self.proposer, persist))]
        if self.deletes:
            out.append((-1, Matcher(self.graph, self.end_plan, "delete", self.homomorphic, window, self.proposer, persist)))
        return out

    def _signed(self, window: tuple[int, int] | None, *by: Column) -> DataFrame:
        total = None
        for sign, m in self._matchers(window, self.persist):
            one = m.stage_counts(*by).withColumn("n", F.col("n") * sign)
            total = one if total is None else total.unionByName(one)
        return total.groupBy(*[c for c in total.columns if c != "n"]).agg(F.sum("n").alias("n"))

    def counts(self, window: tuple[int, int] | None = None) -> DataFrame:
        """query_id, delta_count of the updates with window[0] < seq <= window[1] (default all); 0 if none."""
        return with_zeros(self.graph.edges.sparkSession, self._signed(window), self.patterns, "n").withColumnRenamed("n", "delta_count")

    def counts_by_batch(self, batch_size: int, window: tuple[int, int] | None = None) -> DataFrame:
        """batch_id, query_id, delta_count; batches without a change of a pattern have no row for it."""
        return self._signed(window, batch_of(F.col("seq"), batch_size)).select(F.col("__by0").alias("batch_id"), "query_id", F.col("n").alias("delta_count"))

    def embeddings(self, query: int, window: tuple[int, int] | None = None) -> DataFrame:
        """seq, op, b0, ..: the embeddings that a window's updates make (op 1) and end (op -1)."""
        out = None
        for sign, m in self._matchers(window, False):
            rows = m.embeddings(query)
            one = rows.select("seq", F.lit(sign).alias("op"), *[c for c in rows.columns if c != "seq"])
            out = one if out is None else out.unionByName(one)
        return out

    def explain(self) -> str:
        return self.plan.explain()

"""Batches of updates: a plain batch driver, and Structured Streaming through foreachBatch.

The state between batches is a `Store`: a batch reads the live graph, computes its signed counts,
appends what it changes, and is committed last. A batch that is repeated after its commit does
nothing, one that broke off before is done again over its own folders, and a new engine on the same
folder goes on after the last commit, so no update is lost or counted twice. Order comes from
`seq` in the data, never from arrival; late updates (seq not above the last committed) raise.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftgraph.operators.delta import DeltaEngine, batch_of
from weftgraph.operators.match import with_zeros
from weftgraph.plans.pattern import Pattern
from weftgraph.plans.stats import Degrees
from weftgraph.streaming.state import BEGIN, Commit, Store

#: Batches after which the changes are folded into a new base, and statistics are taken anew.
COMPACT_EVERY = 16


@dataclass
class BatchMetrics:
    batch_id: int
    updates: int
    update_ms: float
    query_ms: float


class EnoughBatches(Exception):
    """Ends a streaming query before a batch beyond its limit; that batch stays to be done."""


class StreamRun:
    """A started streaming query; its end by the batch limit is not an error."""

    def __init__(self, query: StreamingQuery):
        self.query = query

    def awaitTermination(self, timeout: float | None = None) -> bool | None:
        try:
            return self.query.awaitTermination(timeout)
        except StreamingQueryException as e:
            if EnoughBatches.__name__ not in str(e):
                raise
            return True

    def stop(self) -> None:
        self.query.stop()


@dataclass
class StreamEngine:
    """Continuous counts of a set of patterns. `home` is a folder that all executors share."""

    spark: SparkSession
    home: str
    patterns: list[Pattern]
    homomorphic: bool = False
    symmetric: frozenset[int] = frozenset({12})
    compact_every: int = COMPACT_EVERY
    degrees: Degrees | None = None
    store: Store = field(init=False)

    def __post_init__(self) -> None:
        self.store = Store(self.spark, self.home, self.symmetric)

    def start_from(self, vertices: DataFrame, edges: DataFrame) -> None:
        """Writes the first state: vertices(id, label) and edges(src, dst, label). A home that has one raises."""
        self.store.begin(vertices, edges)

    @property
    def metrics(self) -> list[BatchMetrics]:
        return [BatchMetrics(c.batch_id, c.updates, c.update_ms, c.query_ms) for c in self.store.commits if c.batch_id != BEGIN]

    def process(self, updates: DataFrame, batch_id: int) -> None:
        """One batch: updates(seq, kind, op, id1, id2, label); usable as a foreachBatch function."""
        store = self.store
        if store.committed(batch_id):
            return
        began = time.perf_counter()
        updates = updates.persist()
        try:
            last, base = store.last, store.last.base
            low, high, n = updates.agg(F.min("seq"), F.max("seq"), F.count(F.lit(1))).first()
            if n and low <= last.last_seq:
                raise ValueError(f"batch {batch_id} has update {low}, but {last.last_seq} is committed")
            version, upto = last.version + 1, high if n else last.last_seq
            changed, counts = 0, None
            if n:
                graph, touched = store.window(updates)
                if self.degrees is None:
                    self.degrees = Degrees.of(store.edges())
                engine = DeltaEngine(graph, self.patterns, self.homomorphic, deletes=True, degrees=self.degrees)
                counts = engine.counts((last.last_seq, high))
                changed = store.apply(version, touched, high)
            applied = time.perf_counter()
            store.write_counts(batch_id, counts if counts is not None else self._zeros())
            done = time.perf_counter()
            store.commit(Commit(batch_id, version, base, upto, n, changed, 1000 * (applied - began), 1000 * (done - applied)))
            if version - base >= self.compact_every:
                store.rebase()
                self.degrees = None
        finally:
            updates.unpersist()

    def _zeros(self) -> DataFrame:
        return self.spark.createDataFrame([(q, 0) for q in range(len(self.patterns))], "query_id int, delta_count long")

    def run(self, updates: DataFrame, batch_size: int = 1000, max_batches: int | None = 10) -> None:
        """Batches of `batch_size` consecutive updates, at most `max_batches` of those not committed yet; the last may be short.

        The updates are dealt to one folder per batch in one pass, and each batch reads its own.
        """
        path = f"{self.home}/incoming"
        updates.withColumn("batch", batch_of(F.col("seq"), batch_size)).repartition("batch").write.mode("overwrite").partitionBy("batch").parquet(path)
        dealt = self.spark.read.parquet(path)
        left = sorted(b for (b,) in dealt.select(F.col("batch").cast("long")).distinct().collect() if not self.store.committed(b))
        for b in left[:max_batches]:
            self.process(dealt.where(F.col("batch") == b).drop("batch"), b)

    def stream(self, updates: DataFrame, checkpoint: str, max_batches: int | None = None) -> StreamRun:
        """Starts a query over a streaming `updates`, with all data that is there (availableNow).

        With `max_batches`, the query ends before the batch after them; its updates are read again by the next query.
        """
        done = 0

        def step(df: DataFrame, batch_id: int) -> None:
            nonlocal done
            if self.store.committed(batch_id):
                return
            if max_batches is not None and done >= max_batches:
                raise EnoughBatches(EnoughBatches.__name__)
            self.process(df, batch_id)
            done += 1

        return StreamRun(updates.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())

    def counts(self) -> DataFrame:
        """batch_id, query_id, delta_count of all committed batches."""
        return self.store.counts()

    def running(self) -> DataFrame:
        """batch_id, query_id, total: cumulative counts after each batch."""
        return running_counts(self.counts())

    def totals(self) -> DataFrame:
        return with_zeros(self.spark, self.counts().groupBy("query_id").agg(F.sum("delta_count").alias("n")), self.patterns, "n").withColumnRenamed("n", "total")

    def report(self) -> DataFrame:
        """batch_id, updates, update_ms, query_ms of the committed batches."""
        return self.spark.createDataFrame([(m.batch_id, m.updates, m.update_ms, m.query_ms) for m in self.metrics], "batch_id long, updates long, update_ms double, query_ms double")


def running_counts(counts: DataFrame) -> DataFrame:
    """batch_id, query_id, total from batch_id, query_id, delta_count (one row per batch and query)."""
    upto = Window.partitionBy("query_id").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select("batch_id", "query_id", F.sum("delta_count").over(upto).alias("total"))

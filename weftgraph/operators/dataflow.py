"""Generic dataflow operators over DataFrames, including the graph traversal steps.

Column expressions are the rule; `map_partition` takes a function over pandas batches for what
expressions cannot say.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.lineage import cut

#: Distance of an unreached vertex, and the bound of a shortest-path search.
MAX_DISTANCE = 1_000_000
_senders = ThreadPoolExecutor(4, "send-back")


class Flow:
    """A chain of operators; each returns a new Flow, `df` is the result so far."""

    def __init__(self, df: DataFrame):
        self.df = df

    def map(self, *columns: Column | str) -> Flow:
        return Flow(self.df.select(*columns))

    def flat_map(self, values: Column, name: str, optional: bool = False) -> Flow:
        """A row per element of an array column; optional keeps rows without elements."""
        return Flow(self.df.withColumn(name, (F.explode_outer if optional else F.explode)(values)))

    def map_partition(self, f: Callable[[Iterable], Iterable], schema: str) -> Flow:
        return Flow(self.df.mapInPandas(f, schema))

    def filter(self, condition: Column | str) -> Flow:
        return Flow(self.df.where(condition))

    def shuffle(self, *keys: Column | str, shards: int | None = None) -> Flow:
        return Flow(self.df.repartition(shards, *keys) if shards else self.df.repartition(*keys))

    def barrier(self) -> Flow:
        """All rows so far are computed before anything after."""
        return Flow(cut(self.df))

    def top(self, k: int, *order: Column) -> Flow:
        return Flow(self.df.orderBy(*order).limit(k))

    def limit(self, n: int) -> Flow:
        return Flow(self.df.limit(n))

    def reduce(self, keys: list[str], *aggregates: Column) -> Flow:
        return Flow(self.df.groupBy(*keys).agg(*aggregates))

    def union(self, other: Flow) -> Flow:
        return Flow(self.df.unionByName(other.df))

    def loop(self, times: int, body: Callable[[Flow], Flow]) -> Flow:
        """A scope unrolled `times` times."""
        out = self
        for _ in range(times):
            out = body(out)
        return out

    def rename(self, **names: str) -> Flow:
        return Flow(self.df.withColumnsRenamed(names))

    def node_by_id(self, id: int, column: str = "id") -> Flow:
        return Flow(self.df.where(F.col(column) == id))

    def single_edge(self, edges: DataFrame, src: int, dst: int) -> Flow:
        """The edges from one vertex to another."""
        return Flow(edges.where((F.col("src") == src) & (F.col("dst") == dst)))

    def add_bitset(self, index: str, label: str, name: str = "bits") -> Flow:
        """Per value of `label`, the set of `index` (not negative) as bitmaps: label, bucket, `name`.

        A bucket holds the ids of one range of 32,768; `bitmap_count(name)` counts them.
        """
        bucketed = self.df.select(label, F.bitmap_bucket_number(index).alias("bucket"), F.bitmap_bit_position(index).alias("at"))
        return Flow(bucketed.groupBy(label, "bucket").agg(F.bitmap_construct_agg("at").alias(name)))

    def transfer(self, relation: DataFrame, expand_relation: DataFrame, site: str, to: str) -> Flow:
        """Rows of a relation renamed to `site`, each carried over another relation's edges to `to`."""
        return Flow(relation.select(F.col("id").alias(site))).expand(expand_relation, site, to)

    def send_back(self) -> Future:
        """The rows, as a future: the job runs meanwhile."""
        return _senders.submit(self.df.collect)

    def gather(self) -> Iterator:
        """The rows one partition after another, so that the driver holds one at a time."""
        return self.df.toLocalIterator(prefetchPartitions=True)

    def project_node(self, properties: DataFrame, site: str, *columns: str) -> Flow:
        """Adds property columns of the vertex at `site` (properties has an `id`)."""
        return Flow(self.df.join(properties.select(F.col("id").alias(site), *columns), site, "left"))

    def project_edge(self, properties: DataFrame, src: str, dst: str, *columns: str) -> Flow:
        """Adds property columns of the edge between two sites (properties has `src`, `dst`)."""
        return Flow(self.df.join(properties.select(F.col("src").alias(src), F.col("dst").alias(dst), *columns), [src, dst], "left"))

    def expand(self, edges: DataFrame, site: str, to: str, label: int | None = None, direction: str = "out", optional: bool = False) -> Flow:
        """A row per neighbour of the vertex at `site`, in column `to`."""
        a, b = ("src", "dst") if direction == "out" else ("dst", "src")
        e = edges if label is None else edges.where(F.col("label") == label)
        return Flow(self.df.join(e.select(F.col(a).alias(site), F.col(b).alias(to)), site, "left" if optional else "inner"))

    def expand_into(self, edges: DataFrame, src: str, dst: str, label: int | None = None) -> Flow:
        """Rows whose two vertices have an edge."""
        e = edges if label is None else edges.where(F.col("label") == label)
        return Flow(self.df.join(e.select(F.col("src").alias(src), F.col("dst").alias(dst)), [src, dst], "left_semi"))


def visited_expand(edges: DataFrame, start: DataFrame, hops: int | None = None) -> DataFrame:
    """id, distance: breadth-first levels from the ids of `start` over edges(src, dst).

    Each level joins the frontier only and drops what was visited; lineage is cut per level.
    """
    step = edges.select("src", "dst")
    seen = frontier = cut(start.select("id").distinct().withColumn("distance", F.lit(0)))
    level = 0
    while hops is None or level < hops:
        level += 1
        reached = frontier.join(step, frontier["id"] == step["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = cut(reached.join(seen.select("id"), "id", "left_anti").withColumn("distance", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen


def shortest_paths(edges: DataFrame, start: int, weight: str | None = None) -> DataFrame:
    """id, distance: least total weight (default 1 an edge, no negative ones) from `start`."""
    spark = edges.sparkSession
    step = edges.select("src", "dst", (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w"))
    best = changed = cut(spark.createDataFrame([(start, 0.0)], "id long, distance double"))
    while not changed.isEmpty():
        offers = changed.join(step, changed["id"] == step["src"]).select(F.col("dst").alias("id"), (F.col("distance") + F.col("w")).alias("offer")).where(F.col("offer") <= MAX_DISTANCE).groupBy("id").agg(F.min("offer").alias("offer"))
        changed = cut(offers.join(best, "id", "left").where(F.col("distance").isNull() | (F.col("offer") < F.col("distance"))).select("id", F.col("offer").alias("distance")))
        best = cut(best.join(changed.select("id"), "id", "left_anti").unionByName(changed))
    return best


def resource_allocation(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, score: sum of 1/degree over the common neighbours of each pair (0 if none)."""
    e = edges.select("src", "dst").distinct()
    degree = e.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    asked = pairs.select("a", "b").distinct()
    common = asked.join(e.select(F.col("src").alias("a"), F.col("dst").alias("via")), "a").join(e.select(F.col("src").alias("b"), F.col("dst").alias("via")), ["b", "via"])
    scored = common.join(degree.withColumnRenamed("src", "via"), "via").groupBy("a", "b").agg(F.sum(1 / F.col("degree")).alias("score"))
    return asked.join(scored, ["a", "b"], "left").select("a", "b", F.coalesce("score", F.lit(0.0)).alias("score"))

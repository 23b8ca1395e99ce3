"""The live graph between batches: a base and small appended changes, with a commit record for each batch.

Folders under `home`: `base/v{k}` (vertices and edges alive after version k, edges in one folder per
label), `added/v{k}` and `gone/v{k}` (what version k brought and took away, of the keys it touched
only), `counts/b{id}`, and `commits/v{k}`, one row per batch, written last. What has no commit
does not count: a batch that broke off is written again over its own folders.

A row is alive if its key has not gone in a later version than the row's own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.lineage import cut
from weftgraph.operators.graph import NEVER, Graph

EDGE = ["src", "dst", "label"]
SCHEMAS = {
    "vertices": "id long, label int, version long",
    "edges": "src long, dst long, label int, src_label int, dst_label int, version long",
}
COMMIT = "batch_id long, version long, base long, last_seq long, updates long, changed long, update_ms double, query_ms double"
#: The batch id of commits without a batch: the first, and each new base.
BEGIN = -1


@dataclass(frozen=True)
class Commit:
    batch_id: int
    version: int
    base: int
    last_seq: int
    updates: int
    changed: int
    update_ms: float
    query_ms: float


class Store:
    """The versioned state in a folder that all executors share; a new object goes on where the last commit ended."""

    def __init__(self, spark: SparkSession, home: str, symmetric: frozenset[int]):
        self.spark, self.home, self.symmetric = spark, home, symmetric
        self.commits: list[Commit] = []
        try:
            found = spark.read.schema(COMMIT).option("recursiveFileLookup", True).parquet(f"{home}/commits").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            found = []
        self.commits = sorted((Commit(*r) for r in found), key=lambda c: c.version)

    @property
    def last(self) -> Commit:
        if not self.commits:
            raise ValueError(f"{self.home} has no state; call start_from first")
        return self.commits[-1]

    def committed(self, batch_id: int) -> bool:
        return any(c.batch_id == batch_id for c in self.commits)

    def commit(self, c: Commit) -> None:
        self.spark.createDataFrame([tuple(c.__dict__.values())], COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{self.home}/commits/v{c.version}")
        self.commits.append(c)

    def begin(self, vertices: DataFrame, edges: DataFrame) -> None:
        if self.commits:
            raise ValueError(f"{self.home} already has a state")
        g = Graph.of(vertices, edges, symmetric=self.symmetric)
        self._write_base(g.vertices, g.edges, 0)
        self.commit(Commit(BEGIN, 0, 0, 0, 0, 0, 0.0, 0.0))

    def _write_base(self, vertices: DataFrame, edges: DataFrame, version: int) -> None:
        vertices.select("id", "label", F.lit(version).cast("long").alias("version")).write.mode("overwrite").parquet(f"{self.home}/base/v{version}/vertices")
        edges.select(*EDGE, "src_label", "dst_label", F.lit(version).cast("long").alias("version")).write.mode("overwrite").partitionBy("label").parquet(f"{self.home}/base/v{version}/edges")

    def _live(self, kind: str, keys: list[str]) -> DataFrame:
        now, schema = self.last, SCHEMAS[kind]
        rows = self.spark.read.schema(schema).parquet(f"{self.home}/base/v{now.base}/{kind}")
        later = [c.version for c in self.commits if c.version > now.base and c.changed]
        if not later:
            return rows.select(*[c for c in rows.columns if c != "version"])
        added = self.spark.read.schema(schema).parquet(*[f"{self.home}/added/v{v}/{kind}" for v in later])
        gone = self.spark.read.schema(", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", until long").parquet(*[f"{self.home}/gone/v{v}/{kind}" for v in later])
        # changes since the base: the optimiser broadcasts them while they are few
        until = gone.groupBy(*keys).agg(F.max("until").alias("until"))
        joined = rows.unionByName(added).join(until, keys, "left").where("until IS NULL OR version >= until")
        return joined.select(*[c for c in rows.columns if c != "version"])

    def vertices(self) -> DataFrame:
        """id, label of the live vertices."""
        return self._live("vertices", ["id"])

    def edges(self) -> DataFrame:
        """src, dst, label, src_label, dst_label of the live edges."""
        return self._live("edges", EDGE)

    def counts(self) -> DataFrame:
        """batch_id, query_id, delta_count of the committed batches, whichever object ran them."""
        done = [c.batch_id for c in self.commits if c.batch_id != BEGIN]
        schema = "batch_id long, query_id int, delta_count long"
        if not done:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.home}/counts")
        return rows.join(F.broadcast(self.spark.createDataFrame([(b,) for b in done], "batch_id long")), "batch_id", "left_semi")

    def write_counts(self, batch_id: int, counts: DataFrame) -> None:
        rows = counts.select(F.lit(batch_id).cast("long").alias("batch_id"), F.col("query_id").cast("int"), F.col("delta_count").cast("long"))
        rows.write.mode("overwrite").parquet(f"{self.home}/counts/b{batch_id}")

    def window(self, updates: DataFrame) -> tuple[Graph, Touched]:
        """The graph with the lifetimes that `updates` make, and what they touch.

        Only keys that the updates name, and edges of vertices that they delete, go through the
        interval windows; all other edges are read as they are.
        """
        live_v, live_e = self.vertices(), self.edges()
        keyed = updates.where("kind = 'e'").select(F.col("id1").cast("long").alias("src"), F.col("id2").cast("long").alias("dst"), F.col("label").cast("int").alias("label"))
        both = keyed.where(F.col("label").isin(*self.symmetric)).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label") if self.symmetric else keyed.limit(0)
        keys = keyed.unionByName(both).distinct()
        fallen = updates.where("kind = 'v' AND op = -1").select(F.col("id1").cast("long").alias("id")).distinct()
        touched = live_e.join(keys, EDGE, "left_semi")
        if not fallen.isEmpty():
            for end in ("src", "dst"):
                touched = touched.unionByName(live_e.join(fallen.withColumnRenamed("id", end), end, "left_semi"))
        touched_e = cut(touched.distinct())
        named = [updates.select(F.col("id1").cast("long").alias("id")), keyed.select(F.col("dst").alias("id")), *(touched_e.select(F.col(end).alias("id")) for end in ("src", "dst"))]
        ids = named[0]
        for x in named[1:]:
            ids = ids.unionByName(x)
        touched_v = cut(live_v.join(ids.where("id IS NOT NULL").distinct(), "id", "left_semi"))
        changed = Graph.of(touched_v, touched_e.select(*EDGE), updates, self.symmetric).settled()
        zero, never = F.lit(0).cast("long"), F.lit(NEVER)
        rest = live_e.join(touched_e.select(*EDGE), EDGE, "left_anti").withColumn("seq", zero).withColumn("del_seq", never)
        edges = rest.select(*changed.edges.columns).unionByName(changed.edges)
        return Graph(changed.vertices, edges, self.symmetric), Touched(touched_v, touched_e, changed)

    def apply(self, version: int, touched: Touched, upto: int) -> int:
        """Writes what version brings and takes away; the number of such rows."""
        after, total = touched.changed.at(upto), 0
        for kind, keys, old, new in (("vertices", ["id"], touched.vertices, after.vertices), ("edges", EDGE, touched.edges, after.edges)):
            cols = [c.split()[0] for c in SCHEMAS[kind].split(", ")][:-1]
            old, new = old.select(*cols), new.select(*cols)
            # a row that stays alike is neither gone nor added
            gone, added = cut(old.join(new, cols, "left_anti").select(*keys).distinct()), cut(new.join(old, cols, "left_anti"))
            gone.withColumn("until", F.lit(version).cast("long")).write.mode("overwrite").parquet(f"{self.home}/gone/v{version}/{kind}")
            added.withColumn("version", F.lit(version).cast("long")).write.mode("overwrite").parquet(f"{self.home}/added/v{version}/{kind}")
            total += gone.count() + added.count()
        return total

    def rebase(self) -> None:
        """Folds all changes into a new base; its commit is a version of its own."""
        last = self.last
        version = last.version + 1
        self._write_base(self.vertices(), self.edges(), version)
        self.commit(Commit(BEGIN, version, version, last.last_seq, 0, 0, 0.0, 0.0))


@dataclass(frozen=True)
class Touched:
    """Live rows that a batch may change, and the graph of them with its updates."""

    vertices: DataFrame
    edges: DataFrame
    changed: Graph

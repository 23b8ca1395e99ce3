"""The data graph: vertices and edges with validity intervals, as DataFrames.

vertices(id, label, ins_seq, del_seq) and edges(src, dst, label, src_label, dst_label, seq, del_seq).
A row lives on [seq, del_seq); static rows have seq 0, rows never deleted have del_seq NEVER.
Edges of symmetric labels are stored in both directions with one seq.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.lineage import cut
from weftgraph.plans.pattern import SYMMETRIC_LABELS
from weftgraph.plans.stats import Degrees

NEVER = (1 << 63) - 1


def _intervals(events: DataFrame, keys: list[str]) -> DataFrame:
    """Live intervals from (keys, seq, op, ...) events; repeated inserts and deletes of what is not there do nothing."""
    order = Window.partitionBy(*keys).orderBy("seq", "op")
    kept = events.withColumn("__was", F.coalesce(F.lag("op").over(order), F.lit(-1))).where("op <> __was")
    ended = kept.withColumn("del_seq", F.coalesce(F.lead("seq").over(order), F.lit(NEVER)))
    return ended.where("op = 1").drop("op", "__was")


@dataclass
class Graph:
    vertices: DataFrame
    edges: DataFrame
    symmetric: frozenset[int] = SYMMETRIC_LABELS
    known: Degrees | None = field(default=None, compare=False)

    def degrees(self) -> Degrees:
        """Statistics of the edges, taken once."""
        if self.known is None:
            self.known = Degrees.of(self.edges)
        return self.known

    @classmethod
    def of(cls, vertices: DataFrame, edges: DataFrame, updates: DataFrame | None = None, symmetric: frozenset[int] = SYMMETRIC_LABELS) -> Graph:
        """From vertices(id, label), edges(src, dst, label) and updates(seq, kind, op, id1, id2, label).

        Static rows come before all updates. The first live label of a vertex wins; deleting a
        vertex deletes its edges; an edge whose end is not alive is not inserted.
        """
        v = vertices.select(F.col("id").cast("long"), F.lit(0).cast("long").alias("seq"), F.lit(1).alias("op"), F.col("label").cast("int")).groupBy("id", "seq", "op").agg(F.min("label").alias("label"))
        e = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("label").cast("int"), F.lit(0).cast("long").alias("seq"), F.lit(1).alias("op"))
        if updates is not None:
            v = v.unionByName(updates.where("kind = 'v'").select(F.col("id1").cast("long").alias("id"), "seq", "op", F.col("label").cast("int")))
            e = e.unionByName(updates.where("kind = 'e'").select(F.col("id1").cast("long").alias("src"), F.col("id2").cast("long").alias("dst"), F.col("label").cast("int"), "seq", "op"))
        alive = _intervals(v, ["id"]).select("id", "label", F.col("seq").alias("ins_seq"), "del_seq")
        if symmetric:
            mirrored = e.where(F.col("label").isin(*symmetric)).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label", "seq", "op")
            e = e.unionByName(mirrored)
        e = e.distinct()
        for end in ("src", "dst"):
            own = alive.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"), "ins_seq", F.col("del_seq").alias("__until"))
            during = (F.col("seq") >= F.col("ins_seq")) & (F.col("seq") < F.col("__until"))
            # inserts need both ends; deletes name no labels
            e = e.where("op = 1").join(own, end).where(during).drop("ins_seq", "__until").unionByName(e.where("op = -1"), allowMissingColumns=True)
        if updates is not None:
            gone = updates.where("kind = 'v' AND op = -1").select(F.col("id1").cast("long").alias("id"), F.col("seq").alias("at"))
            keys = e.where("op = 1").select("src", "dst", "label").distinct()
            for end in ("src", "dst"):
                fallen = keys.join(gone, keys[end] == gone["id"]).select("src", "dst", "label", F.col("at").alias("seq"), F.lit(-1).alias("op"))
                e = e.unionByName(fallen, allowMissingColumns=True)
            e = e.dropDuplicates(["src", "dst", "label", "seq", "op"])
        live = _intervals(e, ["src", "dst", "label"]).select("src", "dst", "label", "src_label", "dst_label", "seq", "del_seq")
        return cls(alive, live, symmetric)

    def at(self, seq: int) -> Graph:
        """The graph as it is after update `seq`; every row static."""
        v = self.vertices.where((F.col("ins_seq") <= seq) & (F.col("del_seq") > seq))
        e = self.edges.where((F.col("seq") <= seq) & (F.col("del_seq") > seq))
        zero, never = F.lit(0).cast("long"), F.lit(NEVER)
        return Graph(v.withColumn("ins_seq", zero).withColumn("del_seq", never), e.withColumn("seq", zero).withColumn("del_seq", never), self.symmetric)

    def settled(self) -> Graph:
        """The same graph with its lineage cut: plans join the edges many times."""
        return Graph(cut(self.vertices), cut(self.edges), self.symmetric, self.known)

    def counts(self) -> DataFrame:
        """kind, label, rows."""
        v = self.vertices.groupBy("label").agg(F.count(F.lit(1)).alias("rows")).select(F.lit("vertex").alias("kind"), "label", "rows")
        return v.unionByName(self.edges.groupBy("label").agg(F.count(F.lit(1)).alias("rows")).select(F.lit("edge").alias("kind"), "label", "rows"))

    def neighbours(self, ids: DataFrame, label: int, direction: str = "out") -> DataFrame:
        """id, neighbour of each id of `ids` over edges of a label."""
        a, b = ("src", "dst") if direction == "out" else ("dst", "src")
        return ids.select("id").join(self.edges.where(F.col("label") == label).select(F.col(a).alias("id"), F.col(b).alias("neighbour")), "id")

    def save(self, path: str) -> None:
        """Parquet, edges in one folder per label, so that a scan reads only the labels it needs."""
        self.vertices.write.mode("overwrite").parquet(f"{path}/vertices")
        self.edges.write.mode("overwrite").partitionBy("label").parquet(f"{path}/edges")

    @classmethod
    def load(cls, spark, path: str, symmetric: frozenset[int] = SYMMETRIC_LABELS) -> Graph:
        return cls(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"), symmetric)

    def save_bucketed(self, table: str, buckets: int) -> None:
        """Two tables, bucketed by source and by target, so that extension joins shuffle only the prefix rows."""
        for end, suffix in (("src", "out"), ("dst", "in")):
            self.edges.write.mode("overwrite").bucketBy(buckets, end).sortBy(end).saveAsTable(f"{table}_{suffix}")

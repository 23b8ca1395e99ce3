"""Iterative graph algorithms over edges(src, dst), all joins and aggregates; lineage is cut in every round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.lineage import cut


def page_rank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """id, rank of every end of an edge; ranks sum to 1, and vertices without out-edges give theirs to all."""
    links = cut(edges.select("src", "dst").distinct())
    ids = cut(links.select(F.col("src").alias("id")).unionByName(links.select(F.col("dst").alias("id"))).distinct())
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    shares = cut(links.join(links.groupBy("src").agg(F.count(F.lit(1)).alias("degree")), "src"))
    rank = ids.withColumn("rank", F.lit(1.0 / n))
    for _ in range(rounds):
        given = shares.join(rank.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        held = rank.join(shares.select(F.col("src").alias("id")).distinct(), "id", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("held"))
        rank = cut(
            ids.join(given, "id", "left").crossJoin(F.broadcast(held)).select("id", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("held") / n)).alias("rank"))
        )
    return rank


def components(edges: DataFrame) -> DataFrame:
    """id, component (smallest id connected) of every end of an edge, directions aside.

    In every round each vertex takes the smallest label around it and then that label's own label
    (pointer jumping), so long chains take a number of rounds of the order of their logarithm.
    """
    links = edges.select("src", "dst").where("src <> dst")
    both = cut(links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    label = cut(ends.withColumn("component", F.col("id")))
    while True:
        around = both.join(label.select(F.col("id").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("low"))
        near = cut(label.join(around, "id", "left").select("id", "component", F.least("component", F.coalesce("low", "component")).alias("next")))
        # a vertex that heard of a smaller label tells the one it was named after
        told = near.groupBy(F.col("component").alias("id")).agg(F.min("next").alias("heard"))
        hooked = cut(near.join(told, "id", "left").select("id", "component", F.least("next", F.coalesce("heard", "next")).alias("next")))
        jumped = hooked.join(hooked.select(F.col("id").alias("next"), F.col("next").alias("far")), "next")
        moved = cut(jumped.select("id", F.col("component").alias("was"), F.least("next", "far").alias("component")))
        label = moved.select("id", "component")
        if moved.where("was <> component").isEmpty():
            return label


def triangles(edges: DataFrame) -> DataFrame:
    """id, triangles: undirected triangles through each vertex that has one.

    Links point from the lower to the higher degree, so a hub starts few wedges.
    """
    pairs = cut(edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    degree = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    ranked = pairs.join(degree.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    links = cut(ranked.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v")))
    wedges = links.join(links.select("u", F.col("v").alias("w")), "u").where("v < w")
    closed = wedges.join(links.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("w")), ["v", "w"], "left_semi")
    return closed.select(F.explode(F.array("u", "v", "w")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))

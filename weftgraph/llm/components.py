"""Connected components of a link table by star contraction, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import cut

#: Links that one file of a round holds, about.
FILE_ROWS = 500_000


def connected_components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (smallest node connected) of every node of `pairs`.

    Self links, repeats and links with a null end are passed over; no links give an empty table.

    Alternates large-star and small-star steps until no link changes; a step's links are
    at most as many as before plus the nodes, and its lineage is cut through the shared folder.
    A node with many links is only ever reduced to a minimum (partial aggregation) and joined
    with that one row, which adaptive execution splits if it is skewed.
    """
    links, rows = cut(pairs.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()), None
    signature = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above a node move to its minimum
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node's lower neighbours move to its minimum
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        # no more rows than before and their ends: few rows need few files, whatever the session's partitions
        links = cut(small if rows is None else small.coalesce(1 + 3 * rows // FILE_ROWS))
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == signature:
            break
        signature, rows = now, now[0]
    nodes = links.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return nodes.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

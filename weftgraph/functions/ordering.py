"""Distributed row numbers over a total order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, coarse: str, fine: list[str], name: str = "seq") -> DataFrame:
    """Adds `name`: 1, 2, ... in the order of (coarse, *fine), which must be a total order.

    Rows are numbered within each `coarse` value; the offsets come from one row per such value,
    so only those counts (days, say) meet in one task.
    """
    sizes = df.groupBy(coarse).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select(coarse, (F.sum("__n").over(Window.orderBy(coarse).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))
    rank = F.row_number().over(Window.partitionBy(coarse).orderBy(*fine))
    return df.withColumn("__rank", rank).join(before, coarse).withColumn(name, (F.col("__before") + F.col("__rank")).cast("long")).drop("__rank", "__before")

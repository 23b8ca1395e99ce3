"""Operator 6: shards by vector bin packing over bytes, tokens and rows.

Every group of equal texts is placed on the shard where the dot product of its vector with the
shard's residual capacity is highest, and stays together unless it is larger than a whole shard: then it is cut into
pieces of at most half a shard. The groups of over 1/LARGE of a total, at most LARGE for each dimension, are
placed first, largest first, on the driver. All others are dealt to partitions by their key;
each partition has its part of what capacity the large ones left on every shard, and places its groups by
the same rule, largest first. Partitions are even within about a small group each, and so
are the shards.

Slots: rows are numbered in cells of a shard; the number of cells grows with the rows, and each cell has
an offset in its shard, so no shard's rows meet in one task.

Cases: a null text has no bytes and no tokens and null texts are one group; empty texts are
a group; rows that repeat are rows of their own; null ids come first in their cell; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import BROADCAST_BYTES, bounded_batches, cut, small

#: A group of over 1/LARGE of a total is placed by the driver, whose work is bounded by it.
LARGE = 4096
#: Small groups that a partition places, and rows of a cell, about.
PART_GROUPS, CELL_ROWS = 50_000, 50_000
DIMENSIONS = ("bytes", "tokens", "rows")
#: Bytes weigh most: what is left uneven at the end, where few items are small, is then tokens or rows.
WEIGHTS = (3.0, 1.0, 1.0)


def pack(share: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Shard of each item, largest first; share: one row of non-negative weighted loads per item; residual: what is left of each shard, updated."""
    out = np.zeros(len(share), np.int64)
    for i in np.lexsort((np.arange(len(share)), -share.max(axis=1, initial=0.0))):
        best = int(np.argmax(residual @ share[i]))
        out[i] = best
        residual[best] -= share[i]
    return out


def word_count(text: Column) -> Column:
    """Cheap token count: words between blanks."""
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1


def placed_groups(groups: DataFrame, residual: np.ndarray, parts: int) -> DataFrame:
    """key, shard of groups (key, bytes, tokens, rows: weighted shares of the totals), each partition for itself."""
    sums = groups.agg(*(F.sum(c) for c in DIMENSIONS)).first()
    whole = np.array([x or 0.0 for x in sums])
    bounded_batches(groups.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        keys = np.asarray(table["key"])
        share = np.stack([np.asarray(table[c], np.float64) for c in DIMENSIONS], axis=1)
        order = np.argsort(keys, kind="stable")  # ties of size go by key, whatever order rows came in
        keys, share = keys[order], share[order]
        part = share.sum(axis=0) / np.where(whole > 0, whole, 1)
        shard = pack(share, residual * part)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(shard.astype(np.int32))], ["key", "shard"])

    return groups.select("key", *DIMENSIONS).repartition(parts, "key").mapInArrow(run, "key long, shard int")


def pack_shards(
    df: DataFrame, shards: int, id: str = "doc_id", text: str = "text", overhead: int = 16, large: int = LARGE, tokens: Column | None = None,
    weights: tuple[float, ...] = WEIGHTS, part_groups: int = PART_GROUPS, cell_rows: int = CELL_ROWS, most: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row for each input row: doc_id, size, text_crc32, shard, slot.

    `tokens`: each row's token count (default: words between blanks); `overhead`: bytes that a
    row takes besides its text.
    """
    spark = df.sparkSession
    whole = df[text].cast("string")
    slim = cut(
        df.select(
            df[id].alias("doc_id"),
            (F.coalesce(F.octet_length(whole), F.lit(0)).cast("long") + overhead).alias("bytes"),
            F.coalesce(word_count(whole) if tokens is None else tokens, F.lit(0)).cast("long").alias("tokens"),
            F.crc32(F.coalesce(whole, F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(whole, whole.isNull()).alias("key"),
        ).withColumn("rows", F.lit(1).cast("long"))
    )
    # sums of longs are exact, so no order of rows or loss of a task changes a placement
    groups = cut(slim.groupBy("key").agg(*(F.sum(c).alias(c) for c in DIMENSIONS)))
    total = groups.agg(*(F.sum(c).alias(c) for c in DIMENSIONS), F.count(F.lit(1)).alias("groups")).first()
    if not total["rows"]:
        return slim.select("doc_id", F.col("bytes").alias("size"), "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    shared = groups.select("key", *((F.col(c) * w / max(total[c], 1)).alias(c) for c, w in zip(DIMENSIONS, weights)))
    biggest = F.greatest(*(F.col(c) / w for c, w in zip(DIMENSIONS, weights)))
    # over 1/large of a total: at most `large` of them in each dimension
    top = [(r["key"], 1 if r["share"] <= 1 / shards else math.ceil(2 * shards * r["share"])) for r in shared.withColumn("share", biggest).where(F.col("share") > 1 / large).orderBy("key").collect()]
    turn = F.xxhash64(F.lit(7), "doc_id", "text_crc32")
    known = F.broadcast(spark.createDataFrame(top, "key long, pieces int"))
    first = slim.join(known, "key", "left").withColumn("piece", F.pmod(turn, F.col("pieces")).cast("int"))
    # a piece's rows are drawn by hash, so what it holds is summed up before it is placed
    cuts = first.where("piece IS NOT NULL").groupBy("key", "piece").agg(*(F.sum(c).alias(c) for c in DIMENSIONS)).orderBy("key", "piece").collect() if top else []
    residual = np.tile(np.array(weights, float) / shards, (shards, 1))
    vectors = np.array([[r[c] * w / max(total[c], 1) for c, w in zip(DIMENSIONS, weights)] for r in cuts]).reshape(-1, len(DIMENSIONS))
    hot = F.broadcast(spark.createDataFrame([(r["key"], r["piece"], s) for r, s in zip(cuts, pack(vectors, residual).tolist())], "key long, piece int, shard int"))
    rest = shared.join(known.select("key"), "key", "left_anti")
    own = small(cut(placed_groups(rest, residual, max(1, math.ceil(total["groups"] / part_groups)))), most)
    placed = first.where("piece IS NOT NULL").join(hot, ["key", "piece"]).select("doc_id", "bytes", "text_crc32", "shard").unionByName(
        first.where("piece IS NULL").join(own, "key").select("doc_id", "bytes", "text_crc32", "shard")
    )
    cells = max(1, math.ceil(total["rows"] / shards / cell_rows))
    placed = cut(placed.withColumn("cell", F.pmod(F.shiftright(turn, 20), F.lit(cells)).cast("int")))
    filled = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    offsets = cut(filled.select("shard", "cell", (F.sum("n").over(upto) - F.col("n")).alias("offset")))
    number = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32"))
    return placed.withColumn("number", number).join(small(offsets, most), ["shard", "cell"]).select("doc_id", F.col("bytes").alias("size"), "text_crc32", "shard", (F.col("offset") + F.col("number") - 1).cast("long").alias("slot"))

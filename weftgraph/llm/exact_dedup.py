"""Operator 2: exact deduplication, skew-safe, in DataFrame functions only.

Digests are counted first (locally, in salted groups, then globally), which moves some 50 bytes a
row: a digest seen once has no equal text. The content of the others goes through three combining stages, all
keyed by digest *and* full content, so unequal texts never merge whatever the digest does:
copies inside one task collapse before anything is shuffled; the task winners of a
digest meet in `salts` salted groups; the salt winners meet once more. A hot group of copies
therefore sends one row per task, spread over the salts, and then at most `salts` rows.

The winners are mapped back to rows by digest: those of hot digests, which are at most HOT in
number by their size, by a broadcast join, so that no task gets all rows of a hot group; the rest by a
shuffled one. A digest of several contents (a collision) is detected there, and its rows are mapped by content instead.

Cases: a null text counts as empty; empty texts are equal; rows that repeat an id and a text
are one document and get equal marks; a null id wins only among null ids; an empty table
gives an empty table; extra columns are ignored by `exact_groups` and kept by `exact_dedup`,
which drops a row only if its own text has a larger id, whatever else its id names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import BROADCAST_BYTES, cut, fresh, small

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Groups that the task winners of one digest are spread over.
SALTS = 64
#: A digest of more than 1/HOT of all rows is hot.
HOT = 10_000


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; a text without other than ASCII takes the fast built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def sha256(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def _combined(rows: DataFrame, salts: int) -> DataFrame:
    """One row for each (digest, content): keep, n."""
    salted = rows.groupBy("digest", "content", (F.spark_partition_id() % salts).alias("salt")).agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("digest", "content").agg(F.max("keep").alias("keep"), F.sum("n").alias("n"))


def exact_groups(
    df: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    normalise: Callable[[Column], Column] = ascii_lower,
    digest: Callable[[Column], Column] = sha256,
    salts: int = SALTS,
    most: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row for each input row: id, digest, keep (the largest id of its group), n (rows of the group)."""
    content = normalise(F.coalesce(df[text].cast("string"), F.lit("")))
    rows = df.select(df[id].alias("id"), content.alias("content")).select("id", "content", digest(F.col("content")).alias("digest"))
    slim = cut(rows.select("id", "digest"))
    twice = _counted(slim, salts).where("n > 1").select("digest")
    again = rows.join(small(cut(twice), most), "digest", "left_semi")
    groups = cut(_combined(again, salts).groupBy("digest").agg(F.count(F.lit(1)).alias("contents"), F.max("keep").alias("keep"), F.sum("n").alias("n")))
    plain = groups.where("contents = 1").drop("contents")
    hot = plain.where(F.col("n") > slim.count() // HOT)
    found = _marked(slim, hot, plain.join(hot.select("digest"), "digest", "left_anti"), most)
    clashing = groups.where("contents > 1").select("digest")
    if not clashing.isEmpty():
        apart = rows.join(small(cut(clashing), most), "digest", "left_semi")
        exact = _combined(apart, salts)
        found = found.join(small(clashing, most), "digest", "left_anti").unionByName(apart.join(exact, ["digest", "content"]).drop("content"))
    return found.select("id", "digest", "keep", "n")


def _counted(slim: DataFrame, salts: int) -> DataFrame:
    """digest, n."""
    salted = slim.groupBy("digest", (F.spark_partition_id() % salts).alias("salt")).agg(F.count(F.lit(1)).alias("n"))
    return salted.groupBy("digest").agg(F.sum("n").alias("n"))


def _marked(slim: DataFrame, hot: DataFrame, rest: DataFrame, most: int) -> DataFrame:
    """id, digest, keep, n: a row of no group is its own."""
    first = slim.join(F.broadcast(hot.select("digest", F.col("keep").alias("hot_keep"), F.col("n").alias("hot_n"))), "digest", "left")
    rest = small(cut(rest.select("digest", F.col("keep").alias("rest_keep"), F.col("n").alias("rest_n"))), most)
    # rows of hot digests need no other group: they are dealt by their ids
    key = F.when(F.col("hot_n").isNull(), F.col("digest").cast("string")).otherwise(F.concat(F.lit("hot "), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    both = first.withColumn("key", key).join(rest.withColumnRenamed("digest", "other").withColumn("key", F.col("other").cast("string")), "key", "left")
    n = F.coalesce("hot_n", "rest_n", F.lit(1))
    keep = F.when(F.col("hot_n").isNotNull(), F.col("hot_keep")).when(F.col("rest_n").isNotNull(), F.col("rest_keep")).otherwise(F.col("id"))
    return both.select("id", "digest", keep.alias("keep"), n.cast("long").alias("n"))


def exact_dedup(df: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of `df` that stay: of equal texts, the row of the largest id. Columns as in `df`."""
    lost = exact_groups(df, id, text, **how).where(F.col("id") != F.col("keep")).select("id", "digest")
    name, own = fresh(df, "gone"), fresh(df, "digest")
    lost = small(cut(lost.select(F.col("id").alias(name), F.col("digest").alias(own))), how.get("most", BROADCAST_BYTES))
    content = how.get("normalise", ascii_lower)(F.coalesce(df[text].cast("string"), F.lit("")))
    # the second condition is no join key, so that texts are digested only where the id is a loser's
    same = F.array_contains(F.array(lost[own]), how.get("digest", sha256)(content))
    return df.join(lost, (df[id] == lost[name]) & same, "left_anti")

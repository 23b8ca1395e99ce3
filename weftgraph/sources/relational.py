"""A property graph over relational tables (regions, nations, customers, suppliers, parts, orders)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.ordering import numbered
from weftgraph.operators.graph import NEVER, Graph
from weftgraph.plans.stats import Degrees

REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDER = range(6)
#: Edge labels.
IN_REGION, CUSTOMER_NATION, SUPPLIER_NATION, BY_CUSTOMER, HAS_PART, HAS_SUPPLIER, PART_SUPPLIER, PEERS = range(8)
SYMMETRIC = frozenset({PEERS})
#: Key distance of peers, and the first shipping day whose edges are stream updates.
PEER_RANGE, STREAM_FROM = 1000, "2000-12-01"
STRIDE = 1_000_000_000


def vertex(label: int, key: str) -> F.Column:
    return F.lit(label * STRIDE).cast("long") + F.col(key).cast("long")


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def vertices(t: Tables) -> DataFrame:
    """id, label."""
    keys = {REGION: ("region", "r_regionkey"), NATION: ("nation", "n_nationkey"), CUSTOMER: ("customer", "c_custkey"), SUPPLIER: ("supplier", "s_suppkey"), PART: ("part", "p_partkey"), ORDER: ("orders", "o_orderkey")}
    out = None
    for label, (name, key) in keys.items():
        one = t[name].select(vertex(label, key).alias("id"), F.lit(label).alias("label"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def peers(customers: DataFrame) -> DataFrame:
    """a, b: customers of a nation and segment whose keys differ by at most PEER_RANGE, a < b.

    A range join as an equi-join: keys fall in bins as wide as the range, and a key meets the
    keys of its own and the next bin.
    """
    c = customers.select(F.col("c_custkey").alias("k"), "c_nationkey", "c_mktsegment", F.floor(F.col("c_custkey") / PEER_RANGE).alias("bin"))
    left = c.select(F.col("k").alias("a"), "c_nationkey", "c_mktsegment", F.explode(F.array("bin", F.col("bin") + 1)).alias("bin"))
    right = c.withColumnRenamed("k", "b")
    return left.join(right, ["c_nationkey", "c_mktsegment", "bin"]).where((F.col("b") > F.col("a")) & (F.col("b") - F.col("a") <= PEER_RANGE)).select("a", "b").distinct()


def edges(t: Tables) -> DataFrame:
    """src, dst, label, src_label, dst_label, seq, del_seq; later shipments are updates numbered by (day, label, src, dst)."""

    def rows(df: DataFrame, label: int, a: int, akey: str, b: int, bkey: str) -> DataFrame:
        return df.select(vertex(a, akey).alias("src"), vertex(b, bkey).alias("dst"), F.lit(label).alias("label"), F.lit(a).alias("src_label"), F.lit(b).alias("dst_label"))

    fixed = (
        rows(t["nation"], IN_REGION, NATION, "n_nationkey", REGION, "n_regionkey")
        .unionByName(rows(t["customer"], CUSTOMER_NATION, CUSTOMER, "c_custkey", NATION, "c_nationkey"))
        .unionByName(rows(t["supplier"], SUPPLIER_NATION, SUPPLIER, "s_suppkey", NATION, "s_nationkey"))
        .unionByName(rows(t["orders"], BY_CUSTOMER, ORDER, "o_orderkey", CUSTOMER, "o_custkey"))
    )
    pairs = peers(t["customer"])
    fixed = fixed.unionByName(rows(pairs, PEERS, CUSTOMER, "a", CUSTOMER, "b")).unionByName(rows(pairs, PEERS, CUSTOMER, "b", CUSTOMER, "a"))
    # one shuffle-free expansion of each line into its three edges, then one aggregate
    line = t["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_shipdate").alias("ship"))
    three = F.array(
        F.struct(vertex(ORDER, "l_orderkey").alias("src"), vertex(PART, "l_partkey").alias("dst"), F.lit(HAS_PART).alias("label"), F.lit(ORDER).alias("src_label"), F.lit(PART).alias("dst_label")),
        F.struct(vertex(ORDER, "l_orderkey").alias("src"), vertex(SUPPLIER, "l_suppkey").alias("dst"), F.lit(HAS_SUPPLIER).alias("label"), F.lit(ORDER).alias("src_label"), F.lit(SUPPLIER).alias("dst_label")),
        F.struct(vertex(PART, "l_partkey").alias("src"), vertex(SUPPLIER, "l_suppkey").alias("dst"), F.lit(PART_SUPPLIER).alias("label"), F.lit(PART).alias("src_label"), F.lit(SUPPLIER).alias("dst_label")),
    )
    shipped = line.select("ship", F.explode(three).alias("e")).select("e.*", "ship").groupBy("src", "dst", "label", "src_label", "dst_label").agg(F.min("ship").alias("ship"))
    cut_day = F.lit(STREAM_FROM).cast("timestamp")
    static = shipped.where(F.col("ship") < cut_day).drop("ship")
    stream = numbered(shipped.where(F.col("ship") >= cut_day), "ship", ["label", "src", "dst"]).drop("ship")
    zero = F.lit(0).cast("long")
    return fixed.distinct().unionByName(static).withColumn("seq", zero).unionByName(stream).withColumn("del_seq", F.lit(NEVER))


def relational_graph(spark: SparkSession, sf_dir: str) -> Graph:
    t = Tables(spark, sf_dir)
    never = F.lit(NEVER)
    v = vertices(t).select("id", "label", F.lit(0).cast("long").alias("ins_seq"), never.alias("del_seq"))
    return Graph(v, edges(t), SYMMETRIC)


#: Source and target, with their keys, of the labels that come from order lines.
LINES = {HAS_PART: (ORDER, "l_orderkey", PART, "l_partkey"), HAS_SUPPLIER: (ORDER, "l_orderkey", SUPPLIER, "l_suppkey"), PART_SUPPLIER: (PART, "l_partkey", SUPPLIER, "l_suppkey")}


def line_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The edges of order lines as they are after all updates, every row static, for queries that need no other labels or times.

    Nothing is written: an edge's label, ends and times are constants beside two keys. Edges of orders, which have
    few lines, are dealt by order at once, as joins need them. The degrees are those of the lines, which repeat
    some edges, with approximate counts of vertices.
    """
    t = Tables(spark, sf_dir)
    line, found = t["lineitem"], None
    for label, (a, akey, b, bkey) in LINES.items():
        pairs = line.select(vertex(a, akey).alias("src"), vertex(b, bkey).alias("dst"))
        one = (pairs.repartition("src") if a == ORDER else pairs).distinct()
        one = one.select("src", "dst", F.lit(label).alias("label"), F.lit(a).alias("src_label"), F.lit(b).alias("dst_label"))
        found = one if found is None else found.unionByName(one)
    zero, never = F.lit(0).cast("long"), F.lit(NEVER)
    counts = line.agg(F.count(F.lit(1)).alias("n"), *(F.approx_count_distinct(k).alias(k) for k in ("l_orderkey", "l_partkey", "l_suppkey"))).first()
    mean = {}
    for label, (_, akey, _, bkey) in LINES.items():
        mean |= {("out", label): counts["n"] / max(1, counts[akey]), ("in", label): counts["n"] / max(1, counts[bkey])}
    v = vertices(t).select("id", "label", zero.alias("ins_seq"), never.alias("del_seq"))
    return Graph(v, found.withColumn("seq", zero).withColumn("del_seq", never), SYMMETRIC, Degrees(mean, {label: float(counts["n"]) for label in LINES}))

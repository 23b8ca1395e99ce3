"""Evaluation of plans: one DataFrame per stage, left to Catalyst from there.

Rows of a stage: seq (the time of the root update, or 0 for static matching) and b0..bk, the bound
vertices. Extension by a vertex is an equi-join over the cheapest link; the other links of the
same vertex are left-semi joins (or, with proposer="intersect", intersections of adjacency arrays that
start at the smallest; or, with "count", counts of proposals of what the cheapest link proposes). Rows of a stage that several others read
are kept (memory, then disk) while a result is computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.lineage import cut
from weftgraph.operators.graph import Graph
from weftgraph.plans.pattern import Pattern
from weftgraph.plans.planner import Link, Plan, Stage
from weftgraph.plans.stats import Degrees

#: Stages from which a plan is run root by root.
LARGE_PLAN = 80
#: Entries of an adjacency list above which it is split.
LIST = 50_000


class Matcher:
    """Stages of a plan as DataFrames.

    mode: "static" (all rows of the graph, no times), "insert" (root = newly inserted edge, the other
    edges older and alive) or "delete" (root = edge that ends, the others alive until then).
    """

    def __init__(self, graph: Graph, plan: Plan, mode: str = "static", homomorphic: bool = False, window: tuple[int, int] | None = None, proposer: str = "join", persist: bool = True):
        self.graph, self.plan, self.mode, self.homomorphic, self.window, self.proposer, self.persist = graph, plan, mode, homomorphic, window, proposer, persist
        self._rows: dict[int, DataFrame] = {}
        self.persisted: list[DataFrame] = []

    def _edges(self, label: int, src: int, dst: int) -> DataFrame:
        return self.graph.edges.where((F.col("label") == label) & (F.col("src_label") == src) & (F.col("dst_label") == dst))

    def _visible(self, tie: str) -> Column:
        """Whether an edge (columns eseq, edel) counts for a root at `seq`."""
        seq, ins, end = F.col("seq"), F.col("eseq"), F.col("edel")
        if self.mode == "static":
            return F.lit(True)
        if self.mode == "insert":
            return ((ins < seq) if tie == "lt" else (ins <= seq)) & (end > seq)
        return (ins < seq) & ((end > seq) if tie == "lt" else (end >= seq))

    def _seen(self, tie: str):
        """The same as a test of an adjacency entry."""
        seq = F.col("seq")
        if self.mode == "static":
            return lambda y: F.lit(True)
        if self.mode == "insert":
            return lambda y: ((y["eseq"] < seq) if tie == "lt" else (y["eseq"] <= seq)) & (y["edel"] > seq)
        return lambda y: (y["eseq"] < seq) & ((y["edel"] > seq) if tie == "lt" else (y["edel"] >= seq))

    def _root(self, s: Stage) -> DataFrame:
        kind = s.root
        e = self._edges(kind.edge_label, kind.src_label, kind.dst_label)
        at = {"static": F.lit(0).cast("long"), "insert": F.col("seq"), "delete": F.col("del_seq")}[self.mode]
        first, second = ("dst", "src") if s.flipped else ("src", "dst")
        e = e.select(at.alias("seq"), F.col(first).alias("b0"), F.col(second).alias("b1"))
        if self.window:
            e = e.where((F.col("seq") > self.window[0]) & (F.col("seq") <= self.window[1]))
        elif self.mode == "insert":
            e = e.where("seq > 0")
        elif self.mode == "delete":
            e = e.where(F.col("seq") < F.lit((1 << 63) - 1))
        if s.depth == 1:
            e = e.where("b0 = b1").drop("b1")
        elif not self.homomorphic and s.labels[0] == s.labels[1]:
            e = e.where("b0 <> b1")
        for x in sorted(s.links):
            e = self._semi(e, x, s, s.depth - 1)
        return e

    def _side(self, x: Link, labels: tuple[int, ...], new: int) -> DataFrame:
        """Edges of a link as (bound, new_, eseq, edel)."""
        own, other = labels[x.position], labels[new]
        src, dst = (other, own) if x.direction == "in" else (own, other)
        a, b = ("dst", "src") if x.direction == "in" else ("src", "dst")
        return self._edges(x.label, src, dst).select(F.col(a).alias("bound"), F.col(b).alias("new_"), F.col("seq").alias("eseq"), F.col("del_seq").alias("edel"))

    def _semi(self, rows: DataFrame, x: Link, s: Stage, new: int) -> DataFrame:
        if x.direction == "loop":
            new = x.position
        on = (F.col(f"b{x.position}") == F.col("bound")) & (F.col(f"b{new}") == F.col("new_")) & self._visible(x.tie)
        return rows.join(self._side(x, s.labels, new), on, "left_semi")

    def _injective(self, s: Stage) -> Column:
        new = s.depth - 1
        keep = F.lit(True)
        if not self.homomorphic:
            for i, label in enumerate(s.labels[:-1]):
                if label == s.labels[new]:
                    keep = keep & (F.col(f"b{i}") != F.col(f"b{new}"))
        return keep

    def _intersected(self, rows: DataFrame, s: Stage, links: list[Link]) -> DataFrame:
        """Candidates by intersecting visible adjacency lists, the two smallest sides first for each row.

        Only vertices of the rows get lists, and lists are split by the new vertex's hash into as many
        parts as keep a hub's part at about LIST entries; a row meets the parts one by one.
        """
        new = s.depth - 1
        rows, sides, parts = cut(rows), [], 1
        for x in links:
            side = self._side(x, s.labels, new)
            side = cut(side.join(rows.select(F.col(f"b{x.position}").alias("bound")).distinct(), "bound", "left_semi"))
            most = side.groupBy("bound").count().agg(F.max("count")).first()[0] or 0
            sides.append(side)
            parts = max(parts, -(-most // LIST))
        arrays = []
        if parts > 1:
            rows = rows.withColumn("part_", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        for i, (x, side) in enumerate(zip(links, sides)):
            part = F.pmod(F.xxhash64("new_"), F.lit(parts)).cast("int")
            lists = side.groupBy(F.col("bound").alias(f"k{i}"), part.alias(f"p{i}")).agg(F.collect_list(F.struct("new_", "eseq", "edel")).alias(f"n{i}"))
            same = F.col(f"b{x.position}") == F.col(f"k{i}")
            rows = rows.join(lists, same & (F.col("part_") == F.col(f"p{i}")) if parts > 1 else same).drop(f"k{i}", f"p{i}")
            rows = rows.withColumn(f"n{i}", F.transform(F.filter(F.col(f"n{i}"), self._seen(x.tie)), lambda y: y["new_"]))
            arrays.append(f"n{i}")
        sized = F.sort_array(F.array(*(F.struct(F.size(c).alias("size"), F.col(c).alias("ids")) for c in arrays)))
        both = F.aggregate(F.slice(sized, 2, len(arrays)), F.get(sized, F.lit(0))["ids"], lambda acc, y: F.array_intersect(acc, y["ids"]))
        kept = [c for c in rows.columns if c not in arrays and c != "part_"]
        return rows.select(*kept, F.explode(both).alias(f"b{new}"))

    def _counted(self, rows: DataFrame, s: Stage, links: list[Link]) -> DataFrame:
        """Candidates as the vertices that all links propose, by counting the proposals of each.

        The first link, which is the cheapest, lists its proposals; of the others only those of its vertices are
        counted, as no others can be proposed by all.
        """
        new = s.depth - 1
        keys = [*rows.columns, f"b{new}"]
        first = links[0]
        listed = rows.join(self._side(first, s.labels, new), (F.col(f"b{first.position}") == F.col("bound")) & self._visible(first.tie))
        out = listed.withColumn(f"b{new}", F.col("new_")).select(*keys, F.lit(1).alias("hits_"))
        for x in links[1:]:
            # an edge lives once at a time, so a link proposes a vertex once for each row
            on = (F.col(f"b{x.position}") == F.col("bound")) & (F.col(f"b{new}") == F.col("new_")) & self._visible(x.tie)
            out = out.join(self._side(x, s.labels, new), on, "left").select(*keys, (F.col("hits_") + F.col("bound").isNotNull().cast("int")).alias("hits_"))
        return out.where(F.col("hits_") == len(links)).select(*keys)

    def rows(self, s: Stage) -> DataFrame:
        if s.number in self._rows:
            return self._rows[s.number]
        if s.parent is None:
            out = self._root(s)
        else:
            new = s.depth - 1
            if s.base is not None:
                out, rest = self.rows(s.base), sorted(s.links - s.base.links)
            else:
                links = sorted(s.links, key=lambda x: (x.direction == "loop", self.plan.degrees.cost(x.direction, x.label), x))
                plain = [x for x in links if x.direction != "loop"]
                if self.proposer != "join" and len(plain) > 1:
                    propose = {"intersect": self._intersected, "count": self._counted}[self.proposer]
                    out = propose(self.rows(s.parent), s, plain)
                    rest = [x for x in links if x.direction == "loop"]
                else:
                    first, rest = links[0], links[1:]
                    side = self._side(first, s.labels, new)
                    out = self.rows(s.parent).join(side, (F.col(f"b{first.position}") == F.col("bound")) & self._visible(first.tie))
                    out = out.withColumn(f"b{new}", F.col("new_")).drop("bound", "new_", "eseq", "edel")
                out = out.where(self._injective(s))
            for x in rest:
                out = self._semi(out, x, s, new)
        if self.persist and s.parent is not None and self.plan.consumers(s) > 1:  # a root is one filter of the edges
            out = out.persist()
            self.persisted.append(out)
        self._rows[s.number] = out
        return out

    def release(self) -> None:
        """Forgets the kept rows."""
        for df in self.persisted:
            df.unpersist()
        self.persisted.clear()
        self._rows.clear()

    def _root_counts(self, root: Stage, by: tuple[Column, ...], names: list[str]) -> DataFrame | None:
        """query_id, names, n over the stages below one root."""
        counted, finishes = None, []
        for s in root.walk():
            if not s.finishes:
                continue
            one = self.rows(s).select(F.lit(s.number).alias("stage"), *(c.alias(n) for c, n in zip(by, names))).groupBy("stage", *names).agg(F.count(F.lit(1)).alias("n"))
            counted = one if counted is None else counted.unionByName(one)
            times: dict[int, int] = {}
            for f in s.finishes:
                times[f.query] = times.get(f.query, 0) + 1
            finishes += [(s.number, q, t) for q, t in times.items()]
        if counted is None:
            return None
        # the finishes are bounded by the patterns' edges
        table = self.graph.edges.sparkSession.createDataFrame(finishes, "stage int, query_id int, times long")
        return counted.join(F.broadcast(table), "stage").groupBy("query_id", *names).agg(F.sum(F.col("n") * F.col("times")).alias("n"))

    def stage_counts(self, *by: Column) -> DataFrame:
        """query_id, `by` columns (over seq), n: embeddings of each pattern.

        Stages with several consumers are kept until the counts are there; a large plan is run root by
        root, so no single query plan holds the whole trie.
        """
        names = [f"__by{i}" for i in range(len(by))]
        large = sum(1 for _ in self.plan.stages()) > LARGE_PLAN
        total = None
        for root in self.plan.roots:
            one = self._root_counts(root, by, names)
            if one is None:
                continue
            if large:
                one = cut(one)
                self.release()
            total = one if total is None else total.unionByName(one)
        total = total.groupBy("query_id", *names).agg(F.sum("n").alias("n"))
        if self.persisted:
            total = cut(total)  # a row for each pattern and batch
            self.release()
        return total

    def embeddings(self, query: int) -> DataFrame:
        """seq, b0.. of one pattern in the order of its vertices."""
        out = None
        for s in self.plan.stages():
            for f in s.finishes:
                if f.query == query:
                    one = self.rows(s).select("seq", *(F.col(f"b{p}").alias(f"v{i}") for i, p in enumerate(f.position_of)))
                    out = one if out is None else out.unionByName(one)
        width = len(self.plan.patterns[query].labels)
        return out.select("seq", *(F.col(f"v{i}").alias(f"b{i}") for i in range(width)))


def static_plan(patterns: list[Pattern], degrees: Degrees | None = None, share: bool = True) -> Plan:
    """One root instance for each pattern, kept to the stages that lead to it."""
    plan = Plan(patterns, degrees, ties=False, share=share)
    done: set[int] = set()

    def prune(s: Stage) -> bool:
        own = []
        for f in s.finishes:
            if f.query not in done:
                done.add(f.query)
                own.append(f)
        s.finishes = own
        s.children = [c for c in s.children if prune(c)]
        return bool(s.finishes or s.children)

    kept = [r for r in plan.roots if prune(r)]
    alive = {id(s) for r in kept for s in r.walk()}
    for r in kept:
        for s in r.walk():
            if s.base is not None and id(s.base) not in alive:
                s.base = None
    plan.roots = kept
    return plan


def match(graph: Graph, pattern: Pattern, homomorphic: bool = False, degrees: Degrees | None = None, proposer: str = "join") -> DataFrame:
    """b0, b1, ...: embeddings of a pattern in a graph of static rows (see Graph.at)."""
    m = Matcher(graph, static_plan([pattern], degrees or graph.degrees()), "static", homomorphic, proposer=proposer, persist=False)
    return m.embeddings(0).drop("seq")


def match_counts(graph: Graph, patterns: list[Pattern], homomorphic: bool = False, degrees: Degrees | None = None, share: bool = True) -> DataFrame:
    """query_id, total: number of embeddings of each pattern (0 if none)."""
    m = Matcher(graph, static_plan(patterns, degrees or graph.degrees(), share), "static", homomorphic)
    return with_zeros(graph.edges.sparkSession, m.stage_counts(), patterns, "n").withColumnRenamed("n", "total")


def with_zeros(spark, counts: DataFrame, patterns: list[Pattern], column: str) -> DataFrame:
    every = spark.createDataFrame([(q,) for q in range(len(patterns))], "query_id int")
    return F.broadcast(every).join(counts, "query_id", "left").select("query_id", F.coalesce(column, F.lit(0)).cast("long").alias(column))

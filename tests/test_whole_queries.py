"""Registered queries against brute force over whole small tables, not against SQL that shares their bounds."""

import os
from collections import Counter, defaultdict

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from weftgraph import queries_algorithms
from weftgraph.operators.match import Matcher
from weftgraph.queries import TRIANGLE, graph, queries
from weftgraph.sources.relational import CUSTOMER, PEER_RANGE, PEERS, STRIDE, SUPPLIER, line_graph

DATA = "/root/testdata/sf0.001"


def test_visited_expand_reaches_everything(spark, tmp_path):
    for name in os.listdir(DATA):
        if name != "customer.parquet":
            os.symlink(f"{DATA}/{name}", tmp_path / name)
    t = pq.read_table(f"{DATA}/customer.parquet").slice(0, 12).to_pandas()
    t["c_custkey"] = [1 + k * (PEER_RANGE - 100) for k in range(12)]  # a chain: only next ones are peers
    t["c_nationkey"], t["c_mktsegment"] = t.c_nationkey[0], t.c_mktsegment[0]
    t.to_parquet(tmp_path / "customer.parquet")
    got = {r.id: r.distance for r in queries()["visited_expand_bfs"](spark, str(tmp_path)).collect()}
    assert got == {CUSTOMER * STRIDE + k: i for i, k in enumerate(t.c_custkey)}


def test_neighbour_scan_takes_all_suppliers(spark):
    t = pq.read_table(f"{DATA}/lineitem.parquet", columns=["l_orderkey", "l_suppkey"]).to_pandas().drop_duplicates()
    got = {r.supplier: r.n_orders for r in queries()["neighbour_scan"](spark, DATA).collect()}
    assert got == Counter(SUPPLIER * STRIDE + k for k in t.l_suppkey.tolist()) and len(got) > 5


def test_resource_allocation_scores_all_peers(spark):
    g = graph(spark, DATA)
    near = defaultdict(set)
    for r in g.edges.where(F.col("label") == PEERS).select("src", "dst").collect():
        near[r.src].add(r.dst)
    want = {(a, b): round(sum(1 / len(near[v]) for v in near[a] & near[b]), 6) for a in near for b in near[a] if a < b}
    got = {(r.a, r.b): r.score for r in queries()["resource_allocation_index"](spark, DATA).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert any(a % 5 for a, _ in want)


def test_counted_triangles_build_little(spark, monkeypatch):
    """The whole result without the settled graph; only the cheapest link lists its proposals."""
    monkeypatch.setattr(queries_algorithms, "graph", lambda *a: (_ for _ in ()).throw(AssertionError("the whole graph was built")))
    t = pq.read_table(f"{DATA}/lineitem.parquet", columns=["l_orderkey", "l_partkey", "l_suppkey"]).to_pandas()
    parts, suppliers, sold = defaultdict(set), defaultdict(set), set()
    for o, p, s in t.itertuples(index=False):
        parts[o].add(p)
        suppliers[o].add(s)
        sold.add((p, s))
    want = Counter(SUPPLIER * STRIDE + s for o in parts for p in parts[o] for s in suppliers[o] if (p, s) in sold)
    assert {r.supplier: r.n for r in queries_algorithms.match_triangle_counted(spark, DATA).collect()} == want
    joined, counted = [], Matcher._counted

    def seen(self, rows, s, links):
        joined.append(counted(self, rows, s, links)._jdf.queryExecution().optimizedPlan().toString())
        return counted(self, rows, s, links)

    monkeypatch.setattr(Matcher, "_counted", seen)
    queries_algorithms.match(line_graph(spark, DATA), TRIANGLE, proposer="count")
    # proposals are listed once, so no union of what every link proposes
    assert len(joined) == 1 and "Union" not in joined[0]

"""Algorithms, readers and the remaining dataflow steps against brute force."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from test_engine import SMALL, frames, listed, random_stream
from weftgraph.functions.lineage import shared_dir
from weftgraph.operators import match as match_module
from weftgraph.operators.algorithms import components, page_rank, triangles
from weftgraph.operators.dataflow import Flow
from weftgraph.operators.delta import DeltaEngine
from weftgraph.operators.graph import Graph
from weftgraph.plans.pattern import Pattern
from weftgraph.plans.planner import Plan
from weftgraph.plans.stats import Degrees
from weftgraph.sources.text import pattern_text, read_patterns, read_updates

EMPTY = "src long, dst long"


def random_edges(rng, n, m):
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


def test_page_rank(spark):
    pairs = set(random_edges(random.Random(1), 12, 25)) | {(20, 0), (1, 21)}  # 21 has no out-edges
    ids = sorted({x for p in pairs for x in p})
    rank = dict.fromkeys(ids, 1 / len(ids))
    out = {v: [b for a, b in pairs if a == v] for v in ids}
    for _ in range(7):
        held = sum(rank[v] for v in ids if not out[v])
        rank = {v: 0.15 / len(ids) + 0.85 * (sum(rank[a] / len(out[a]) for a, b in pairs if b == v) + held / len(ids)) for v in ids}
    got = {r.id: r["rank"] for r in page_rank(spark.createDataFrame([*pairs, *pairs], EMPTY), 7).collect()}
    assert got.keys() == rank.keys() and all(abs(got[v] - rank[v]) < 1e-12 for v in ids) and abs(sum(got.values()) - 1) < 1e-9
    assert page_rank(spark.createDataFrame([], EMPTY)).count() == 0


def test_components(spark):
    pairs = random_edges(random.Random(2), 60, 40) + [(100 + i, 101 + i) for i in range(30)] + [(200, 200)] + [(300, 300 + i) for i in range(1, 20)]
    up = {x: x for p in pairs for x in p}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    assert {r.id: r.component for r in components(spark.createDataFrame(pairs, EMPTY)).collect()} == {x: top(x) for x in up}
    assert components(spark.createDataFrame([], EMPTY)).count() == 0


def test_triangles(spark):
    pairs = random_edges(random.Random(3), 15, 50) + [(0, i) for i in range(1, 15)]
    near = {x: {b for p in pairs for a, b in (p, p[::-1]) if a == x} - {x} for x in range(15)}
    want = {x: n for x in near if (n := sum(b in near[a] for a in near[x] for b in near[x] if a < b))}
    assert {r.id: r.triangles for r in triangles(spark.createDataFrame(pairs, EMPTY)).collect()} == want


def test_update_lines_are_numbered_over_splits(spark, tmp_path):
    """Several files, split in the middle of lines; blanks, CRLF and a missing last newline."""
    lines = [f"{'-' if i % 7 == 0 else ''}{'v' if i % 5 == 0 else 'e'} {i} {'' if i % 5 == 0 else f'{i + 1} '}{i % 3}" for i in range(3000)]
    for k in range(3):
        (tmp_path / f"part-{k}.txt").write_text("\r\n".join(x + ("\n\n" if i % 50 == 0 else " ") for i, x in enumerate(lines[1000 * k : 1000 * k + 1000])))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    rows = read_updates(spark, str(tmp_path)).orderBy("seq").collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.seq for r in rows] == list(range(1, 3001)) and [r.id1 for r in rows] == list(range(3000))
    assert all((r.kind, r.op, r.id2, r.label) == ("v" if i % 5 == 0 else "e", -1 if i % 7 == 0 else 1, None if i % 5 == 0 else i + 1, i % 3) for i, r in enumerate(rows))


def test_patterns_of_a_folder(spark, tmp_path):
    for i in (10, 2, 1):
        (tmp_path / f"Q{i}.txt").write_text(pattern_text(Pattern.of(f"Q{i}", [0, 1], [(0, 1, i)])))
    assert [(p.name, p.edges[0].label) for p in read_patterns(spark, str(tmp_path))] == [("Q1", 1), ("Q2", 2), ("Q10", 10)]


def test_flow_steps(spark):
    rows = spark.createDataFrame([(i * 7919, i % 3) for i in range(300)] * 2, "id long, owner long")
    counted = Flow(rows).add_bitset("id", "owner").reduce(["owner"], F.sum(F.bitmap_count("bits")).alias("n")).df
    assert listed(counted) == [(0, 100), (1, 100), (2, 100)]
    edges = spark.createDataFrame([(1, 2, 0), (1, 2, 5), (2, 1, 0)], "src long, dst long, label int")
    assert listed(Flow(edges).single_edge(edges, 1, 2).df) == [(1, 2, 0), (1, 2, 5)]
    moved = Flow(edges).transfer(spark.createDataFrame([(1,), (9,)], "id long"), edges.where("label = 0"), "a", "b")
    assert listed(moved.df) == [(1, 2)]
    assert moved.send_back().result() == moved.df.collect() == list(moved.gather())


def test_proposers_agree(spark, monkeypatch):
    """Joins, intersections of whole and of split lists, and counts of proposals."""
    labels, edges, updates = random_stream(random.Random(19))
    g = Graph.of(*frames(spark, labels, edges, [u for u in updates if u[0] == "e"])).settled()
    want = listed(DeltaEngine(g, SMALL[:2]).counts())
    assert listed(DeltaEngine(g, SMALL[:2], proposer="count").counts()) == want
    monkeypatch.setattr(match_module, "LIST", 2)
    assert listed(DeltaEngine(g, SMALL[:2], proposer="intersect").counts()) == want


def test_roots_bind_the_simpler_end_first():
    star = Pattern.of("star", [0, 1, 1, 1], [(0, 1, 3), (0, 2, 3), (0, 3, 3)])
    assert all(r.flipped and r.labels == (1, 0) for r in Plan([star]).roots)
    assert not any(r.flipped for r in Plan([Pattern.of("in", [1, 0, 0], [(1, 0, 3), (2, 0, 3)])]).roots)


def test_containment_follows_the_cost():
    """A step is taken from a sibling's rows only where those are few."""
    wedge = Pattern.of("wedge", [0, 0, 1], [(0, 1, 5), (0, 2, 3)])
    closed = Pattern.of("closed", [0, 0, 1], [(0, 1, 5), (0, 2, 3), (1, 2, 4)])
    few = Degrees({("out", 3): 2.0, ("in", 3): 2.0, ("out", 4): 50.0, ("in", 4): 50.0}, {3: 100.0, 4: 5000.0, 5: 100.0})
    many = Degrees({("out", 3): 500.0, ("in", 3): 500.0, ("out", 4): 1.0, ("in", 4): 1.0}, {3: 50_000.0, 4: 100.0, 5: 100.0})
    bases = [[s.base for r in Plan([wedge, closed], d).roots if r.root.edge_label == 5 for s in r.children if len(s.links) == 2] for d in (few, many)]
    assert len(bases[0]) == len(bases[1]) == 1 and bases[0][0] is not None and bases[1][0] is None


def test_a_cluster_must_name_its_folder():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: d)))

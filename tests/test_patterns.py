"""Patterns, parsing and the shared planner (no Spark)."""

import random
import re
from collections import Counter
from itertools import product
from pathlib import Path

import pytest

from weftgraph.plans.pattern import EdgeType, Pattern, edge_types, instances
from weftgraph.plans.planner import Plan
from weftgraph.sources.text import load_patterns, parse_pattern

FIXTURES = Path(__file__).resolve().parent.parent / "FIXTURES.md"


def corpus() -> list[Pattern]:
    """The pattern table of the fixtures file."""
    rows = re.findall(r"^\| (Q\d+_\d+) \| \d+ \| \d+ \| \d+ \| \d+ \| ([\d ]+) \| ([\d>: ]+) \|$", FIXTURES.read_text(), re.M)
    return [Pattern.of(n, list(map(int, v.split())), [tuple(map(int, re.split("[>:]", e))) for e in w.split()]) for n, v, w in rows]


def live_matches(p: Pattern, labels: dict[int, int], edges: set, homomorphic: bool) -> set:
    """Brute force: all bindings over a set of (src, dst, label), undirected labels stored both ways."""
    candidates = [[v for v, x in labels.items() if x == want] for want in p.labels]
    return {b for b in product(*candidates) if (homomorphic or len(set(b)) == len(b)) and all((b[e.src], b[e.dst], e.label) in edges for e in p.edges)}


def random_case(rng: random.Random, types: list[EdgeType], size: int, n_edges: int, symmetric: frozenset):
    wanted = sorted({x for t in types for x in t[:2]})
    labels = {i: wanted[i % len(wanted)] for i in range(size)}
    out = []
    for _ in range(n_edges):
        t = rng.choice(types)
        a = rng.choice([v for v, x in labels.items() if x == t.src_label])
        b = rng.choice([v for v, x in labels.items() if x == t.dst_label])
        out.append((a, b, t.edge_label))
    return labels, out


def mirrored(edges, symmetric):
    return set(edges) | {(b, a, x) for a, b, x in edges if x in symmetric}


def run_plan(plan: Plan, labels, edge_seq: dict, homomorphic: bool) -> Counter:
    """The plan interpreted on a small graph: edge_seq maps (src, dst, label) to its time, 0 = static."""
    counts, rows = Counter(), {}

    def ok(seq, root, tie):
        return seq < root or (tie == "le" and seq == root)

    def has(row, root, x, new):
        other = row[x.position] if x.direction == "loop" else new
        key = (row[x.position], other, x.label) if x.direction != "in" else (other, row[x.position], x.label)
        return key in edge_seq and ok(edge_seq[key], root, x.tie)

    for s in plan.stages():
        if s.parent is None:
            found = []
            for (a, b, label), seq in edge_seq.items():
                if seq and (labels[a], labels[b], label) == tuple(s.root) and (a == b if s.depth == 1 else homomorphic or a != b):
                    row = (a,) if s.depth == 1 else (b, a) if s.flipped else (a, b)
                    if all(has(row, seq, x, row[-1]) for x in s.links):
                        found.append((seq, row))
        else:
            found = [(q, (*r, v)) for q, r in rows[s.parent.number] for v, x in labels.items() if x == s.labels[-1] and (homomorphic or v not in r) and all(has((*r, v), q, x, v) for x in s.links)]
            if s.base is not None:
                assert s.base.links < s.links and s.base.labels == s.labels
        rows[s.number] = found
        for f in s.finishes:
            counts[f.query] += len(found)
    return counts


def test_corpus_profile():
    patterns = corpus()
    assert len(patterns) == 66 and sum(len(p.edges) for p in patterns) == 325
    assert len(edge_types(patterns)) == 23
    assert sum(len(x) for x in instances(patterns).values()) == 360
    for p in patterns:
        p.check()


@pytest.mark.parametrize("share", [True, False])
@pytest.mark.parametrize("homomorphic", [False, True])
def test_plan_is_an_exact_delta(share, homomorphic):
    """after - before, on every corpus pattern and on odd patterns, by an interpreter of the plan."""
    rng = random.Random(5)
    odd = [
        Pattern.of("loop", [1], [(0, 0, 3)]),
        Pattern.of("loop_tail", [1, 1], [(0, 0, 3), (0, 1, 3)]),
        Pattern.of("anti", [1, 1], [(0, 1, 3), (1, 0, 4)]),
        Pattern.of("double", [1, 1], [(0, 1, 3), (0, 1, 4)]),
        Pattern.of("knows_triangle", [0, 0, 0], [(0, 1, 12), (1, 2, 12), (0, 2, 12)]),
    ]
    for group in ([p for p in corpus() if len(p.labels) <= 5], odd):
        types = edge_types(group)
        for _ in range(2 if group is odd else 1):
            labels, edges = random_case(rng, types, 12, 40, frozenset({12}))
            first: dict = {}
            for i, (a, b, x) in enumerate(edges):
                seq = 0 if i < 25 else i
                for key in {(a, b, x), (b, a, x)} if x == 12 else {(a, b, x)}:
                    first.setdefault(key, seq)
            counts = run_plan(Plan(group, ties=homomorphic, share=share), labels, first, homomorphic)
            for q, p in enumerate(group):
                after = live_matches(p, labels, set(first), homomorphic)
                before = live_matches(p, labels, {e for e, s in first.items() if s == 0}, homomorphic)
                assert counts[q] == len(after) - len(before), p.name


def test_sharing_needs_fewer_stages():
    patterns = corpus()
    shared, apart = Plan(patterns), Plan(patterns, share=False)
    assert len(list(shared.stages())) < 0.8 * len(list(apart.stages()))
    assert "=> " in shared.explain() and "from stage" in shared.explain()
    assert shared.max_depth() == 8


def test_parser_traps(tmp_path):
    p = parse_pattern("v 0 1\r\nv 1 3 \r\n\r\ne 0 1 5", "x")
    assert p.labels == [1, 3] and [tuple(e) for e in p.edges] == [(0, 1, 5)]
    for bad in ("v 0", "q 1 2", "v 1 0", "v 0 1\ne 0 9 1"):
        with pytest.raises(ValueError):
            parse_pattern(bad, "bad")
    for name in ("Q1_10", "Q1_2", "Q1_1"):
        (tmp_path / f"{name}.txt").write_text("v 0 1\nv 1 1\ne 0 1 3")
    assert [p.name for p in load_patterns(str(tmp_path))] == ["Q1_1", "Q1_2", "Q1_10"]


def test_builder():
    p = Pattern.of("p", [0, 0, 1], [(0, 1, 12), (1, 0, 12), (0, 2, 3), (0, 2, 3), (0, 2, 4)])
    assert len(p.edges) == 3 and p.edge_labels(1, 0) == [12] and p.edge_labels(2, 0) == [] and p.edge_labels(0, 2) == [3, 4]
    assert p.degree(0) == 3 and len(p.out_edges(1)) == 1 and len(p.in_edges(2)) == 2
    with pytest.raises(ValueError):
        Pattern.of("apart", [0, 0, 0], [(0, 1, 3)]).check()

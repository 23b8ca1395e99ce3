"""The Spark engine against the worked example and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from test_patterns import live_matches, mirrored, random_case
from weftgraph.operators.delta import DeltaEngine
from weftgraph.operators.graph import Graph
from weftgraph.operators.match import match, match_counts
from weftgraph.plans.pattern import EdgeType, Pattern
from weftgraph.sources.text import parse_pattern, read_edges, read_updates, read_vertices
from weftgraph.streaming.engine import StreamEngine

# The worked example (fixed values of the fixtures file).
VERTICES = "v 0 1\nv 1 3\nv 2 2 \nv 3 0\nv 4 3\nv 5 1\nv 6 0\nv 7 3"
EDGES = "e 0 2 4\r\ne 3 0 13\r\ne 1 3 21\ne 1 6 21\ne 2 3 18\ne 2 6 18\ne 4 3 21\ne 7 6 21\ne 5 2 4\ne 5 4 5\ne 5 7 5"
UPDATES = "e 0 1 5"
EXAMPLE = {
    "Q1": "v 0 1\nv 1 3\nv 2 2\nv 3 0\ne 0 1 5\ne 0 2 4\ne 1 3 21",
    "Q2": "v 0 1\nv 1 3\nv 2 2\nv 3 0\ne 0 1 5\ne 0 2 4\ne 1 3 21\ne 2 3 18\ne 3 0 13",
    "Q3": "v 0 1\nv 1 3\nv 2 2\nv 3 0\nv 4 1\nv 5 3\ne 0 1 5\ne 0 2 4\ne 1 3 21\ne 4 2 4\ne 5 3 21\ne 4 5 5",
    "Q4": "v 0 1\nv 1 3\nv 2 2\nv 3 0\nv 4 3\ne 0 1 5\ne 0 2 4\ne 1 3 21\ne 2 3 18\ne 4 3 21",
    "Q5": "v 0 1\nv 1 3\nv 2 2\nv 3 0\ne 0 1 5\ne 0 2 4\ne 2 3 18\ne 3 0 13",
}
PATTERNS = [parse_pattern(t, n) for n, t in EXAMPLE.items()]


@pytest.fixture(scope="module", autouse=True)
def plain_plans(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.fixture(scope="module")
def example(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("example")
    for name, text in (("v", VERTICES), ("e", EDGES), ("u", UPDATES)):
        (d / f"{name}.txt").write_text(text)
    return Graph.of(read_vertices(spark, f"{d}/v.txt"), read_edges(spark, f"{d}/e.txt"), read_updates(spark, f"{d}/u.txt")).settled()


def listed(df):
    return [tuple(r) for r in df.orderBy(*df.columns).collect()]


def test_worked_example(example):
    assert listed(DeltaEngine(example, PATTERNS).counts()) == list(enumerate([2, 1, 4, 2, 1]))
    assert listed(DeltaEngine(example, PATTERNS, share=False).counts()) == list(enumerate([2, 1, 4, 2, 1]))
    assert listed(match_counts(example.at(0).settled(), PATTERNS)) == list(enumerate([2, 0, 0, 2, 0]))


def test_worked_example_homomorphic(example):
    assert listed(DeltaEngine(example, PATTERNS, homomorphic=True).counts()) == list(enumerate([2, 1, 6, 4, 1]))


def test_embeddings(example):
    found = DeltaEngine(example, PATTERNS).embeddings(2)
    assert listed(found.drop("seq", "op")) == [(0, 1, 2, 3, 5, 4), (0, 1, 2, 6, 5, 7), (5, 4, 2, 3, 0, 1), (5, 7, 2, 6, 0, 1)]


def test_bad_lines_raise(spark, tmp_path):
    (tmp_path / "bad.txt").write_text("e 1 2 3\nx 1 2 3\n")
    with pytest.raises(Exception, match="not a graph line"):
        read_edges(spark, f"{tmp_path}/bad.txt").collect()


SYM = frozenset({12})
SMALL = [
    Pattern.of("wedge", [0, 1, 0], [(0, 1, 3), (2, 1, 3)]),
    Pattern.of("friends", [0, 0, 1], [(0, 1, 12), (0, 2, 3), (1, 2, 3)]),
    Pattern.of("anti", [0, 0], [(0, 1, 12), (0, 0, 5)]),
]


def replay(labels, edges, updates):
    """(vertex labels, edge set) after each update, from 0 on, by plain Python."""
    v, e = dict(labels), set(mirrored(edges, SYM))
    states = [(dict(v), set(e))]
    for kind, op, a, b, label in updates:
        if kind == "v":
            if op > 0:
                v.setdefault(a, label)
            else:
                v.pop(a, None)
                e = {x for x in e if a not in x[:2]}
        else:
            both = {(a, b, label), (b, a, label)} if label in SYM else {(a, b, label)}
            if op > 0 and a in v and b in v:
                e |= both
            elif op < 0:
                e -= both
        states.append((dict(v), set(e)))
    return states


def random_stream(rng):
    types = [EdgeType(0, 1, 3), EdgeType(0, 0, 12), EdgeType(0, 0, 5)]
    labels, edges = random_case(rng, types, 8, 14, SYM)
    updates = []
    for _ in range(24):
        if rng.random() < 0.15:
            a = rng.randrange(8)
            updates.append(("v", rng.choice([1, -1]), a, None, labels[a]))
        else:
            a, b, x = rng.choice(edges) if rng.random() < 0.4 else random_case(rng, types, 8, 1, SYM)[1][0]
            updates.append(("e", rng.choice([1, 1, -1]), a, b, x))
    return labels, edges, updates


def frames(spark, labels, edges, updates):
    v = spark.createDataFrame(list(labels.items()), "id long, label int")
    e = spark.createDataFrame(edges, "src long, dst long, label int")
    u = spark.createDataFrame([(i + 1, *x) for i, x in enumerate(updates)], "seq long, kind string, op int, id1 long, id2 long, label int")
    return v, e, u


@pytest.mark.parametrize("seed,homomorphic", [(1, False), (2, True), (3, False)])
def test_signed_deltas_equal_brute_force(spark, seed, homomorphic):
    labels, edges, updates = random_stream(random.Random(seed))
    g = Graph.of(*frames(spark, labels, edges, updates)).settled()
    states = replay(labels, edges, updates)
    totals = [[len(live_matches(p, *s, homomorphic)) for p in SMALL] for s in states]
    engine = DeltaEngine(g, SMALL, homomorphic, deletes=True)
    for size in (1, 7):
        got = {(b, q): n for b, q, n in listed(engine.counts_by_batch(size))}
        for b in range(-(-len(updates) // size)):
            end = min(len(updates), (b + 1) * size)
            for q in range(len(SMALL)):
                assert got.get((b, q), 0) == totals[end][q] - totals[b * size][q], (b, q)
    last, final = g.at(len(updates)).settled(), states[-1]
    assert {(r.src, r.dst, r.label) for r in last.edges.collect()} == final[1]
    assert listed(match(last, SMALL[1], homomorphic)) == sorted(live_matches(SMALL[1], *final, homomorphic))


def test_intersecting_proposer_agrees(spark):
    labels, edges, updates = random_stream(random.Random(9))
    g = Graph.of(*frames(spark, labels, edges, [u for u in updates if u[0] == "e"])).settled()
    p = SMALL[:2]
    assert listed(DeltaEngine(g, p, proposer="intersect").counts()) == listed(DeltaEngine(g, p).counts())


def test_large_plan_runs_root_by_root(spark, monkeypatch):
    from weftgraph.operators import match as module

    labels, edges, updates = random_stream(random.Random(11))
    g = Graph.of(*frames(spark, labels, edges, updates)).settled()
    whole = listed(DeltaEngine(g, SMALL).counts())
    monkeypatch.setattr(module, "LARGE_PLAN", 1)
    assert listed(DeltaEngine(g, SMALL).counts()) == whole


def test_batches_and_stream_agree(spark, tmp_path):
    labels, edges, updates = random_stream(random.Random(4))
    v, e, u = frames(spark, labels, edges, updates)
    states = replay(labels, edges, updates)
    change = [len(live_matches(p, *states[-1], False)) - len(live_matches(p, *states[0], False)) for p in SMALL[:1]]
    batches = StreamEngine(spark, str(tmp_path / "b"), SMALL[:1])
    batches.start_from(v, e)
    batches.run(u, batch_size=10)
    assert listed(batches.totals()) == list(enumerate(change))
    batches.process(u.where("seq > 20 AND seq <= 30"), 2)  # a batch that is run again counts once
    assert listed(batches.totals()) == list(enumerate(change)) and len(batches.metrics) == 3
    with pytest.raises(ValueError, match="committed"):
        batches.process(u.where("seq <= 5"), 3)
    with pytest.raises(ValueError, match="already"):
        batches.start_from(v, e)
    u.coalesce(1).write.parquet(str(tmp_path / "updates"))
    stream = StreamEngine(spark, str(tmp_path / "s"), SMALL[:1])
    stream.start_from(v, e)
    stream.stream(spark.readStream.schema(u.schema).parquet(str(tmp_path / "updates")), str(tmp_path / "c")).awaitTermination()
    assert listed(stream.totals()) == list(enumerate(change)) and stream.report().count() == 1


@pytest.mark.parametrize("seed,compact_every", [(14, 2), (15, 16)])
def test_restarted_engines_agree_with_brute_force(spark, tmp_path, seed, compact_every):
    """A new engine for every batch, with vertex deletions and re-inserted edges; each batch run twice."""
    labels, edges, updates = random_stream(random.Random(seed))
    v, e, u = frames(spark, labels, edges, updates)
    states, p = replay(labels, edges, updates), SMALL[:2]
    StreamEngine(spark, str(tmp_path), p).start_from(v, e)
    for b in range(4):
        some = u.where((F.col("seq") > 6 * b) & (F.col("seq") <= 6 * b + 6))
        for _ in range(2):
            engine = StreamEngine(spark, str(tmp_path), p, compact_every=compact_every)
            engine.process(some, b)
        now = states[6 * b + 6]
        assert {(r.src, r.dst, r.label) for r in engine.store.edges().collect()} == now[1]
        assert {(r.id, r.label) for r in engine.store.vertices().collect()} == set(now[0].items())
        assert listed(engine.totals()) == [(q, len(live_matches(x, *now, False)) - len(live_matches(x, *states[0], False))) for q, x in enumerate(p)]


def test_a_broken_batch_is_done_again(spark, tmp_path, monkeypatch):
    labels, edges, updates = random_stream(random.Random(16))
    v, e, u = frames(spark, labels, edges, updates)
    states, p = replay(labels, edges, updates), SMALL[:1]
    StreamEngine(spark, str(tmp_path), p).start_from(v, e)
    first = StreamEngine(spark, str(tmp_path), p)
    first.process(u.where("seq <= 12"), 0)
    with monkeypatch.context() as m:
        m.setattr(first.store, "commit", lambda c: 1 / 0)  # state and counts of batch 1 are written, its commit is not
        with pytest.raises(ZeroDivisionError):
            first.process(u.where("seq > 12"), 1)
    again = StreamEngine(spark, str(tmp_path), p)
    assert len(again.metrics) == 1
    again.process(u.where("seq > 12"), 1)
    assert listed(again.totals()) == [(0, len(live_matches(p[0], *states[-1], False)) - len(live_matches(p[0], *states[0], False)))]


def test_limited_stream_goes_on_where_it_ended(spark, tmp_path):
    labels, edges, updates = random_stream(random.Random(17))
    v, e, u = frames(spark, labels, edges, updates)
    states, p = replay(labels, edges, updates), SMALL[:1]
    for k in range(3):
        u.where((F.col("seq") > 8 * k) & (F.col("seq") <= 8 * k + 8)).coalesce(1).write.mode("append").parquet(str(tmp_path / "updates"))
    want = [(0, len(live_matches(p[0], *states[n], False)) - len(live_matches(p[0], *states[0], False))) for n in (8, 24)]
    source = spark.readStream.schema(u.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "updates"))
    engine = StreamEngine(spark, str(tmp_path / "s"), p)
    engine.start_from(v, e)
    engine.stream(source, str(tmp_path / "c"), max_batches=1).awaitTermination()
    assert listed(engine.totals()) == want[:1]
    engine = StreamEngine(spark, str(tmp_path / "s"), p)
    engine.stream(source, str(tmp_path / "c")).awaitTermination()
    assert listed(engine.totals()) == want[1:] and len(engine.metrics) == 3


def test_graph_files(example, spark, tmp_path):
    example.save(str(tmp_path / "g"))
    again = Graph.load(spark, str(tmp_path / "g"))
    assert listed(again.edges.select(*example.edges.columns)) == listed(example.edges)
    assert listed(example.neighbours(spark.createDataFrame([(5,)], "id long"), 5)) == [(5, 4), (5, 7)]


def test_command_line(spark, tmp_path, capsys):
    from weftgraph.__main__ import main

    (tmp_path / "q").mkdir()
    for name, text in (("v", VERTICES), ("e", EDGES), ("u", UPDATES), ("q/Q1", EXAMPLE["Q1"]), ("q/Q5", EXAMPLE["Q5"])):
        (tmp_path / f"{name}.txt").write_text(text)
    main(["-v", f"{tmp_path}/v.txt", "-e", f"{tmp_path}/e.txt", "-q", f"{tmp_path}/q", "-u", f"{tmp_path}/u.txt", "-show", "true", "-explain", "true", "-out", f"{tmp_path}/out"])
    said = capsys.readouterr().out
    assert "Q1: 2\nQ5: 1\n" in said and "batch 0: 1 updates" in said and "root (1, 3, 5)" in said


def test_empty_updates_in_a_batch(spark, tmp_path):
    v, e, u = frames(spark, {0: 0, 1: 1}, [(0, 1, 3)], [("e", 1, 0, 1, 3)])
    engine = StreamEngine(spark, str(tmp_path / "x"), SMALL[:1])
    engine.start_from(v, e)
    engine.process(u.limit(0), 0)
    engine.process(u, 1)
    assert listed(engine.totals()) == [(0, 0)]

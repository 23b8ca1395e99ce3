"""DuckDB SQL for the graph queries, written from the tables alone (plain self joins)."""

from __future__ import annotations

from weftgraph.plans.pattern import Pattern, edge_types, instances
from weftgraph.queries import BATCH, DELETE_AFTER, DELETE_EVERY, DROP_EVERY, PATTERNS, TRIANGLE
from weftgraph.queries_algorithms import RANK_ROUNDS
from weftgraph.queries_io import KEPT, REVIVED
from weftgraph.sources.relational import PEER_RANGE, STREAM_FROM

_K = 1_000_000_000
FOREVER = (1 << 63) - 1

_GRAPH = f"""
fixed AS (
  SELECT {1 * _K} + n_nationkey AS src, 0 + n_regionkey AS dst, 0 AS label, 1 AS sl, 0 AS dl FROM nation
  UNION SELECT {2 * _K} + c_custkey, {1 * _K} + c_nationkey, 1, 2, 1 FROM customer
  UNION SELECT {3 * _K} + s_suppkey, {1 * _K} + s_nationkey, 2, 3, 1 FROM supplier
  UNION SELECT {5 * _K} + o_orderkey, {2 * _K} + o_custkey, 3, 5, 2 FROM orders
  UNION SELECT {2 * _K} + a.c_custkey, {2 * _K} + b.c_custkey, 7, 2, 2
    FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment
    WHERE a.c_custkey <> b.c_custkey AND abs(a.c_custkey - b.c_custkey) <= {PEER_RANGE}
),
shipped AS (
  SELECT {5 * _K} + l_orderkey AS src, {4 * _K} + l_partkey AS dst, 4 AS label, 5 AS sl, 4 AS dl, min(l_shipdate) AS ship FROM lineitem GROUP BY 1, 2
  UNION ALL SELECT {5 * _K} + l_orderkey, {3 * _K} + l_suppkey, 5, 5, 3, min(l_shipdate) FROM lineitem GROUP BY 1, 2
  UNION ALL SELECT {4 * _K} + l_partkey, {3 * _K} + l_suppkey, 6, 4, 3, min(l_shipdate) FROM lineitem GROUP BY 1, 2
),
edges AS MATERIALIZED (
  SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, label, sl, dl, CAST(0 AS BIGINT) AS seq FROM fixed
  UNION ALL SELECT src, dst, label, sl, dl, 0 FROM shipped WHERE ship < TIMESTAMP '{STREAM_FROM}'
  UNION ALL SELECT src, dst, label, sl, dl, row_number() OVER (ORDER BY ship, label, src, dst) FROM shipped WHERE ship >= TIMESTAMP '{STREAM_FROM}'
)"""


def _body(p: Pattern, homomorphic: bool = False) -> tuple[str, str, list[str]]:
    """(FROM, WHERE without times, column of each vertex) of a pattern's plain self join."""
    var: dict[int, str] = {}
    where = []
    for i, e in enumerate(p.edges):
        where.append(f"e{i}.label = {e.label} AND e{i}.sl = {p.labels[e.src]} AND e{i}.dl = {p.labels[e.dst]}")
        for v, c in ((e.src, f"e{i}.src"), (e.dst, f"e{i}.dst")):
            if v in var:
                where.append(f"{c} = {var[v]}")
            else:
                var[v] = c
    if not homomorphic:
        where += [f"{var[x]} <> {var[y]}" for x in var for y in var if x < y and p.labels[x] == p.labels[y]]
    return ", ".join(f"edges e{i}" for i in range(len(p.edges))), " AND ".join(where), [var[v] for v in range(len(p.labels))]


def _new(p: Pattern, columns, homomorphic: bool = False) -> str:
    """One branch per root position; `columns(root alias, vertex columns)` is the select list."""
    tables, where, var = _body(p, homomorphic)
    branches = []
    for k in range(len(p.edges)):
        older = " ".join(f"AND e{i}.seq {'<' if i < k else '<='} e{k}.seq" for i in range(len(p.edges)) if i != k)
        branches.append(f"SELECT {columns(f'e{k}', var)} FROM {tables} WHERE {where} AND e{k}.seq > 0 {older}")
    return " UNION ALL ".join(branches)


def _counts(patterns: list[Pattern], homomorphic: bool = False) -> str:
    return " UNION ALL ".join(f"SELECT CAST({q} AS INTEGER) AS query_id, count(*) AS delta_count FROM ({_new(p, lambda e, v: '1', homomorphic)})" for q, p in enumerate(patterns))


def _delta(*names: str) -> str:
    return f"WITH {_GRAPH} {_counts([p for p in PATTERNS if p.name in names])}"


def _signed(p: Pattern) -> str:
    """All embeddings with their lifetime, as one self join over intervals."""
    tables, where, _ = _body(p)
    n = len(p.edges)
    made = f"greatest({', '.join(f'e{i}.seq' for i in range(n))})" if n > 1 else "e0.seq"
    ended = f"least({', '.join(f'e{i}.del_seq' for i in range(n))})" if n > 1 else "e0.del_seq"
    # every counted embedding has a stream edge; rooting the join at each keeps it small
    branches = []
    for k in range(n):
        older = " ".join(f"AND e{i}.seq {'<' if i < k else '<='} e{k}.seq" for i in range(n) if i != k)
        branches.append(f"SELECT {made} AS made, {ended} AS ended FROM {tables} WHERE {where} AND e{k}.seq > 0 {older}")
    return " UNION ALL ".join(branches)


_TRIANGLES = _new(TRIANGLE, lambda e, v: f"{e}.seq AS seq, " + ", ".join(f"{c} AS b{i}" for i, c in enumerate(v)))
_BATCH = f"CAST(floor((seq - 1) / {BATCH}) AS BIGINT)"
_BY_BATCH = " UNION ALL ".join(
    f"SELECT {_BATCH} AS batch_id, CAST({q} AS INTEGER) AS query_id, count(*) AS delta_count FROM ({_new(p, lambda e, v: f'{e}.seq AS seq')}) GROUP BY 1" for q, p in enumerate(PATTERNS)
)
_DELETES = f"""WITH {_GRAPH.replace('edges AS MATERIALIZED', 'plain AS')},
edges AS MATERIALIZED (SELECT src, dst, label, sl, dl, 2 * seq AS seq, CASE WHEN seq > 0 AND seq % {DELETE_EVERY} = 0 THEN 2 * (seq + {DELETE_AFTER}) + 1 ELSE {FOREVER} END AS del_seq FROM plain),
lives AS ({' UNION ALL '.join(f'SELECT CAST({q} AS INTEGER) AS query_id, made, ended FROM ({_signed(p)}) WHERE made < ended' for q, p in enumerate(PATTERNS[:5]))}),
changes AS (SELECT query_id, made AS seq, 1 AS op FROM lives UNION ALL SELECT query_id, ended, -1 FROM lives WHERE ended < {FOREVER})
SELECT CAST(floor((seq - 1) / {2 * BATCH}) AS BIGINT) AS batch_id, query_id, CAST(sum(op) AS BIGINT) AS delta_count FROM changes GROUP BY 1, 2"""


def _values(rows: list[tuple], names: str) -> str:
    return f"(VALUES {', '.join(str(tuple(r)) for r in rows)}) AS t({names})"


_VERTICES = """vertices AS (
  SELECT 0 + r_regionkey AS id, 0 AS label FROM region UNION SELECT %d + n_nationkey, 1 FROM nation UNION SELECT %d + c_custkey, 2 FROM customer
  UNION SELECT %d + s_suppkey, 3 FROM supplier UNION SELECT %d + p_partkey, 4 FROM part UNION SELECT %d + o_orderkey, 5 FROM orders
)""" % tuple(k * _K for k in range(1, 6))


def _page_rank(rounds: int) -> str:
    """The rounds one after another, as tables."""
    steps = []
    for i in range(rounds):
        got = f"SELECT dst AS id, sum(p / d) AS got FROM links JOIN deg USING (src) JOIN r{i} ON r{i}.id = src GROUP BY dst"
        held = f"(SELECT coalesce(sum(p), 0) FROM r{i} WHERE id NOT IN (SELECT src FROM deg))"
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT r{i}.id, (1 - 0.85::DOUBLE) / n + 0.85::DOUBLE * (coalesce(got, 0) + {held} / n) AS p FROM r{i} CROSS JOIN total LEFT JOIN ({got}) g ON g.id = r{i}.id)")
    return f"""WITH {_GRAPH}, links AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges WHERE label IN (1, 3)), deg AS (SELECT src, count(*) AS d FROM links GROUP BY src),
ids AS (SELECT src AS id FROM links UNION SELECT dst FROM links), total AS (SELECT count(*) AS n FROM ids),
r0 AS (SELECT id, 1::DOUBLE / n AS p FROM ids CROSS JOIN total), {", ".join(steps)}
SELECT id, round(p * n, 6) AS score FROM r{rounds} CROSS JOIN total"""


def oracle_sql() -> dict[str, str]:
    types = [(i, *t) for i, t in enumerate(edge_types(PATTERNS))]
    roots = [(q, *t, a, b) for t, found in instances(PATTERNS).items() for q, a, b in found]
    shapes = [(q, k, e.src, e.dst, *p.edge_type(e)) for q, p in enumerate(PATTERNS) for k, e in enumerate(p.edges)]
    survivors = [(*t, " ".join(str(q) for q in sorted({q for q, _, _ in found}) if q in KEPT)) for t, found in instances(PATTERNS).items()]
    path2 = f"SELECT e0.src AS b0, e0.dst AS b1, e1.dst AS b2 FROM edges e0, edges e1 WHERE e0.label = 3 AND e1.label = 1 AND e0.dst = e1.src"
    tables, where, var = _body(TRIANGLE)
    peers = "peers AS MATERIALIZED (SELECT src, dst FROM edges WHERE label = 7)"
    bfs = f"""WITH RECURSIVE {_GRAPH}, {peers},
walk AS (SELECT min(src) AS id, 0 AS distance FROM peers UNION SELECT p.dst, w.distance + 1 FROM walk w JOIN peers p ON w.id = p.src WHERE w.distance < (SELECT count(DISTINCT src) FROM peers))
SELECT id, CAST(min(distance) AS %s) AS distance FROM walk GROUP BY id"""
    return {
        "graph_edges_by_label": f"WITH {_GRAPH} SELECT label, count(*) AS n_edges, CAST(sum(CASE WHEN seq > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_stream FROM edges GROUP BY label",
        "graph_vertices_by_label": "SELECT 0 AS label, count(DISTINCT r_regionkey) AS n_vertices FROM region UNION ALL SELECT 1, count(DISTINCT n_nationkey) FROM nation UNION ALL SELECT 2, count(DISTINCT c_custkey) FROM customer UNION ALL SELECT 3, count(DISTINCT s_suppkey) FROM supplier UNION ALL SELECT 4, count(DISTINCT p_partkey) FROM part UNION ALL SELECT 5, count(DISTINCT o_orderkey) FROM orders",
        "graph_degree_stats": f"WITH {_GRAPH} SELECT label, count(*) AS n_edges, round(count(*) / count(DISTINCT src), 6) AS mean_out, round(count(*) / count(DISTINCT dst), 6) AS mean_in FROM edges GROUP BY label",
        "scan_updates_typed": f"WITH {_GRAPH} SELECT seq, CAST(edge_type AS INTEGER) AS edge_type, src, dst FROM edges JOIN {_values(types, 'edge_type, tsl, tdl, tlabel')} ON sl = tsl AND dl = tdl AND label = tlabel WHERE seq > 0",
        "update_range": f"WITH {_GRAPH} SELECT seq, src, dst, label FROM edges WHERE seq BETWEEN 101 AND 300",
        "root_instances": f"SELECT query_id, src_label, dst_label, edge_label, src_var, dst_var FROM {_values(roots, 'query_id, src_label, dst_label, edge_label, src_var, dst_var')}",
        "neighbour_scan": f"WITH {_GRAPH} SELECT dst AS supplier, count(*) AS n_orders FROM edges WHERE label = 5 GROUP BY dst",
        "match_path2_static": f"WITH {_GRAPH} {path2}",
        "match_triangle_static": f"WITH {_GRAPH} SELECT 0 AS query_id, count(*) AS total FROM {tables} WHERE {where}",
        "match_triangle_intersect": f"WITH {_GRAPH} SELECT {var[2]} AS supplier, count(*) AS n FROM {tables} WHERE {where} GROUP BY 1",
        "delta_edge1": _delta("edge1"),
        "delta_path_order_part_order": _delta("order_part_order"),
        "delta_triangle": _delta("triangle"),
        "delta_square_cust": _delta("square_customer"),
        "delta_sym_wedge": _delta("peer_wedge"),
        "delta_local_supply": _delta("local_supply"),
        "delta_homo_vs_iso": f"WITH {_GRAPH} SELECT 'iso' AS mode, * FROM ({_counts([PATTERNS[1], PATTERNS[3]])}) UNION ALL SELECT 'homo', * FROM ({_counts([PATTERNS[1], PATTERNS[3]], True)})",
        "delta_counts_by_batch": f"WITH {_GRAPH} {_BY_BATCH}",
        "running_counts": f"WITH {_GRAPH}, by_batch AS ({_BY_BATCH}) SELECT batch_id, query_id, CAST(sum(delta_count) OVER (PARTITION BY query_id ORDER BY batch_id) AS BIGINT) AS total FROM by_batch",
        "signed_delta_deletes": _DELETES,
        "vertex_tombstone_cascade": f"WITH {_GRAPH}, gone AS (SELECT {2 * _K} + c_custkey AS id FROM customer WHERE c_custkey % {DROP_EVERY} = 0 AND c_custkey > 0) SELECT label, count(*) AS n_edges FROM edges WHERE label IN (1, 3, 7) AND src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone) GROUP BY label",
        "shared_plan_counts": f"WITH {_GRAPH} {_counts(PATTERNS)}",
        "unshared_plan_counts": f"WITH {_GRAPH} {_counts(PATTERNS)}",
        "embedding_rows": f"WITH {_GRAPH} {_TRIANGLES}",
        "sink_lines": f"WITH {_GRAPH} SELECT concat(seq, ' --Query: 0 -- ', b0, ' ', b1, ' ', b2) AS line FROM ({_TRIANGLES})",
        "stream_counts": f"WITH {_GRAPH} SELECT query_id, delta_count AS total FROM ({_counts([PATTERNS[1], PATTERNS[2]])})",
        "topk_hot_vertices": f"WITH {_GRAPH} SELECT b1 AS part, count(*) AS n_new FROM ({_TRIANGLES}) GROUP BY b1 ORDER BY n_new DESC, part LIMIT 10",
        "expand_optional": f"WITH {_GRAPH} SELECT DISTINCT {2 * _K} + c_custkey AS customer, (SELECT count(*) FROM edges WHERE label = 3 AND dst = {2 * _K} + c_custkey) AS n_orders FROM customer",
        "expand_into": f"WITH {_GRAPH} SELECT a.dst AS p, count(*) AS n FROM edges a JOIN edges b ON a.src = b.src WHERE a.label = 4 AND a.seq > 0 AND b.label = 5 AND EXISTS (SELECT 1 FROM edges c WHERE c.label = 6 AND c.src = a.dst AND c.dst = b.dst) GROUP BY 1",
        "visited_expand_bfs": bfs % "INTEGER",
        "sssp": bfs % "BIGINT",
        "resource_allocation_index": f"WITH {_GRAPH}, {peers}, deg AS (SELECT src, count(*) AS d FROM peers GROUP BY src) SELECT p.src AS a, p.dst AS b, round(coalesce(sum(1 / d), 0), 6) AS score FROM peers p LEFT JOIN (SELECT x.src AS xa, y.src AS yb, d FROM peers x JOIN peers y ON x.dst = y.dst JOIN deg ON deg.src = x.dst) c ON p.src = xa AND p.dst = yb WHERE p.src < p.dst GROUP BY 1, 2",
        "project_node_props": f"WITH {_GRAPH} SELECT p_brand, count(*) AS n_new FROM ({_TRIANGLES}) JOIN part ON b1 = {4 * _K} + p_partkey GROUP BY 1",
        "project_edge_props": f"WITH {_GRAPH}, line AS (SELECT {5 * _K} + l_orderkey AS o, {4 * _K} + l_partkey AS p, sum(CAST(l_quantity AS DECIMAL(18,2))) AS q FROM lineitem GROUP BY 1, 2) SELECT b2 AS supplier, CAST(sum(q) AS DOUBLE) AS quantity FROM ({_TRIANGLES}) JOIN line ON b0 = o AND b1 = p GROUP BY 1",
        "node_by_id": f"SELECT DISTINCT {2 * _K} + c_custkey AS id, 2 AS label FROM customer WHERE c_custkey = 1",
        "map_partition_rows": f"WITH {_GRAPH} SELECT label, count(*) AS n, max(seq) AS last_seq FROM edges WHERE seq > 0 GROUP BY label",
        "flat_map_rows": f"WITH {_GRAPH} SELECT id, count(*) AS n FROM (SELECT src AS id FROM edges WHERE seq > 0 UNION ALL SELECT dst FROM edges WHERE seq > 0) GROUP BY id HAVING count(*) >= 20",
        "shuffle_barrier": f"WITH {_GRAPH} SELECT CAST(dst % 8 AS INTEGER) AS shard, count(*) AS n FROM edges WHERE seq > 0 GROUP BY 1",
        "read_text_graph": f"WITH {_GRAPH}, {_VERTICES} SELECT 'vertex' AS kind, label, count(*) AS n FROM vertices GROUP BY label UNION ALL SELECT 'edge', label, count(*) FROM edges GROUP BY label",
        "read_update_stream": f"WITH {_GRAPH} SELECT seq, 'e' AS kind, CAST(1 AS INTEGER) AS op, src AS id1, dst AS id2, CAST(label AS INTEGER) AS label FROM edges WHERE seq > 0",
        "read_pattern_folder": f"SELECT query_id, edge_pos, src_var, dst_var, src_label, dst_label, edge_label FROM {_values(shapes, 'query_id, edge_pos, src_var, dst_var, src_label, dst_label, edge_label')}",
        "first_label_wins": f"WITH {_VERTICES} SELECT CASE WHEN label = 2 AND (id - {2 * _K}) % 3 = 0 AND id > {2 * _K} THEN {REVIVED} ELSE label END AS label, count(*) AS n_vertices FROM vertices GROUP BY 1",
        "late_updates": "SELECT * FROM (VALUES (0, true), (1, false), (2, true)) AS t(batch_id, accepted)",
        "surviving_queries": f"WITH {_GRAPH} SELECT seq, queries, dst AS last FROM edges JOIN {_values(survivors, 'tsl, tdl, tlabel, queries')} ON sl = tsl AND dl = tdl AND label = tlabel WHERE seq > 0 AND queries <> ''",
        "limit_rows": f"WITH {_GRAPH} SELECT count(*) AS n FROM (SELECT * FROM edges LIMIT 100)",
        "send_back": f"WITH {_GRAPH} SELECT CAST(seq > 0 AS INTEGER) AS streamed, label, count(*) AS n FROM edges GROUP BY 1, 2",
        "page_rank_orders": _page_rank(RANK_ROUNDS),
        "peer_components": f"""WITH RECURSIVE {_GRAPH}, {peers}, reach AS (SELECT src AS id, src AS root FROM peers UNION SELECT p.dst, r.root FROM reach r JOIN peers p ON p.src = r.id)
SELECT id, min(root) AS component FROM reach GROUP BY id""",
        "peer_triangles": f"""WITH {_GRAPH}, {peers}, t AS (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM peers a JOIN peers b ON a.dst = b.src JOIN peers c ON c.src = a.src AND c.dst = b.dst WHERE a.src < a.dst AND b.src < b.dst)
SELECT id, count(*) AS triangles FROM (SELECT x AS id FROM t UNION ALL SELECT y FROM t UNION ALL SELECT z FROM t) GROUP BY id""",
        "match_triangle_counted": f"WITH {_GRAPH} SELECT {var[2]} AS supplier, count(*) AS n FROM {tables} WHERE {where} GROUP BY 1",
        "single_edge_scan": f"WITH {_GRAPH}, {peers}, one AS (SELECT src, min(dst) AS dst FROM peers WHERE src = (SELECT min(src) FROM peers) GROUP BY src) SELECT edges.src, edges.dst, label FROM edges JOIN one ON edges.src = one.src AND edges.dst = one.dst",
        "parts_bitset": f"WITH {_GRAPH} SELECT dst AS supplier, count(DISTINCT src) AS n_parts FROM edges WHERE label = 6 GROUP BY dst",
        "transfer_customers": f"WITH {_GRAPH} SELECT dst AS nation, count(*) AS n_customers FROM edges WHERE label = 1 GROUP BY dst",
        "loop_unrolled": f"WITH {_GRAPH}, {peers} SELECT c.dst AS at, count(*) AS paths FROM peers a JOIN peers b ON a.dst = b.src JOIN peers c ON b.dst = c.src WHERE a.src = (SELECT min(src) FROM peers) GROUP BY 1",
    }

"""Registered graph queries against their SQL on the smallest tables."""

import duckdb
import pytest

from weftgraph.oracle import oracle_sql
from weftgraph import queries_algorithms, queries_io
from weftgraph.queries import queries as graph_queries
from weftgraph.sources.relational import Tables, peers

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()
NAMES = "graph_edges_by_label match_path2_static match_triangle_intersect delta_triangle delta_sym_wedge topk_hot_vertices project_edge_props loop_unrolled shuffle_barrier sssp neighbour_scan visited_expand_bfs resource_allocation_index shared_plan_counts stream_counts".split()
OTHERS = queries_io.queries() | queries_algorithms.queries()


def queries():
    return graph_queries() | OTHERS



@pytest.mark.parametrize("name", [*NAMES, *OTHERS])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries()[name](spark, DATA)
    want = con.sql(oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(tuple(r) for r in df.select(*want.columns).collect()) == sorted(want.fetchall())


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


def test_peers_by_bins(spark):
    rows = [(k, k % 2, "s") for k in (1, 3, 999, 1000, 1001, 1003, 2001, 2002)]
    got = {tuple(r) for r in peers(spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_mktsegment string")).collect()}
    assert got == {(a, b) for a, n, _ in rows for b, m, _ in rows if n == m and 0 < b - a <= 1000}


def test_tables_read_by_name(spark):
    assert Tables(spark, DATA)["region"].count() == 5

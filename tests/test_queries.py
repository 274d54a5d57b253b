"""Every registered query of the core against its SQL on the smallest test data."""

import math
import os

import duckdb
import pytest

from mnemic.plans import graph_queries, read_queries, record_queries, store_queries, stream_queries, vector_queries

DATA = "/root/testdata/sf0.001"
MODULES = (record_queries, vector_queries, store_queries, graph_queries, read_queries, stream_queries)
QUERIES = {n: f for m in MODULES for n, f in m.QUERIES.items()}
SQL = {n: s for m in MODULES for n, s in m.ORACLE.items()}
#: Iterative ones are tested on fixtures in test_store.py.
SLOW = {"hierarchy_build", "gnn_propagate", "graph_summary", "node_features", "core_numbers", "graph_communities", "community_modularity"}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def _norm(v):
    if isinstance(v, float):
        assert not math.isnan(v), "a NaN equals nothing"
        return float(f"{v:.9g}") + 0.0
    return tuple(map(_norm, v)) if isinstance(v, (list, tuple)) else v


def test_every_sql_has_a_query():
    assert SQL.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rel = db.sql(SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr) == sorted((tuple(_norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys() - SLOW))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns and len(df.collect()) > 0

"""Registered llm queries: against SQL where there is one, else invariants, on the smallest test data."""

import os

import duckdb
import pytest

from mnemic.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    df = QUERIES[name](spark, DATA)
    rel = db.sql(ORACLE[name])
    assert {tuple(r[c] for c in rel.columns) for r in df.collect()} == set(rel.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE.keys()))
def test_rows_are_distinct(spark, name):
    rows = [repr(r) for r in QUERIES[name](spark, DATA).collect()]
    assert len(rows) == len(set(rows))


def test_mix_keeps_to_its_limits(spark):
    for r in QUERIES["p8_shares"](spark, DATA).collect():
        assert r.most_repeats <= r.max_repeats

"""Orphan references, heavy keys and components, with the cases each docstring defines."""

import random

import pytest
from pyspark.sql import functions as F

from mnemic.operators import hotkeys, orphans
from mnemic.operators.components import components

EDGE = "id long, head_id long, tail_id long, relation string, weight double, source string, created_at double"


def _tables(spark, edges, aliases=(), entities=(), documents=(), tombstones=()):
    return (
        spark.createDataFrame(list(edges), EDGE + ", k long, r string"),  # extra columns whose names clash with inner ones
        spark.createDataFrame(list(aliases), "id long, entity_id long, surface string, created_at double"),
        spark.createDataFrame(list(entities), "id long, created_at double, kind string"),
        spark.createDataFrame(list(documents), "doc_id long, anchor string, created_at double"),
        spark.createDataFrame(list(tombstones), "table_name string, ref_key string, deleted_at double, restored_at double"),
    )


def _edge(i, h, t, source=None, at=100.0):
    return (i, h, t, "r", 1.0, source, at, 7, "x")


def test_orphans_by_reason(spark):
    day = 86400.0
    t = _tables(
        spark,
        [_edge(1, 1, 9, " A/1#p2 ", 40 * day), _edge(2, 2, 1, "a/2", 40 * day), _edge(3, 1, 1, "", 40 * day), _edge(4, None, 1, None, None), _edge(5, 3, 1, "a/1", 40 * day), _edge(6, 4, 1, None, 40 * day), _edge(7, 77, 1, None, None)],
        aliases=[(1, 8, "x", 40 * day), (2, None, "y", 1.0)],
        entities=[(1, 0.0, "k"), (2, 50 * day, "k"), (3, 0.0, "k"), (4, 0.0, "k"), (4, 0.0, "k")],
        documents=[(1, "a/1", 0.0), (2, None, 0.0)],
        tombstones=[("entities", "3", 10 * day, None), ("entities", "4", 10 * day, 20 * day), ("entities", "no number", 1.0, None), ("documents", "a/1", 41 * day, None)],
    )
    got = {(r.table_name, r.ref_field, r.row_id): (r.period, r.reason) for r in orphans.orphans(*t).collect()}
    assert got == {
        ("edges", "tail_id", 1): ("1970-02", "missing"),
        ("edges", "head_id", 2): ("1970-02", "later"),
        ("edges", "source", 2): ("1970-02", "missing"),
        ("edges", "head_id", 5): ("1970-02", "deleted"),
        ("edges", "head_id", 7): (None, "missing"),
        ("aliases", "entity_id", 1): ("1970-02", "missing"),
    }


def test_orphans_of_empty_tables(spark):
    t = _tables(spark, [])
    assert orphans.orphans(*t).count() == 0
    assert orphans.orphans(*_tables(spark, [_edge(1, 5, 5, "z")])).count() == 3


def test_orphans_of_a_hot_key_are_sliced(spark, monkeypatch):
    monkeypatch.setattr(orphans, "SLICE_ROWS", 50)
    monkeypatch.setattr(orphans, "RANGE_ROWS", 20)
    rng = random.Random(1)
    edges = [_edge(i, 7 if i % 3 else rng.randrange(200), rng.randrange(200), None, 5.0) for i in range(900)]
    t = _tables(spark, edges, entities=[(k, 0.0, "") for k in range(0, 200, 2)])
    got = {(r.ref_field, r.row_id) for r in orphans.orphans(*t).collect()}
    assert got == {(f, e[0]) for e in edges for f, v in (("head_id", e[1]), ("tail_id", e[2])) if v % 2}


def test_key_totals_against_a_plain_aggregate(spark):
    rng = random.Random(2)
    rows = [(i, 5 if rng.random() < 0.4 else rng.randrange(-9000, 9000), rng.choice([3, None, 10**12 + 1]), rng.choice([" Is A", "is-a", "owns", None]), rng.choice([0.25, 1.5, None, float("nan")]), None, None) for i in range(3000)]
    df = spark.createDataFrame(rows, EDGE).repartition(7)
    got = {(r.side, r.entity_id): r for r in hotkeys.key_totals(df).collect()}
    want = {}
    for _, h, t, rel, w, *_ in rows:
        rel = {None: ""}.get(rel, (rel or "").strip().lower().replace(" ", "_").replace("-", "_"))
        for side, k in (("head", h), ("tail", t)):
            if k is not None:
                x = want.setdefault((side, k), [0, {}])
                x[0] += 1
                x[1][rel] = x[1].get(rel, 0.0) + (0.0 if w is None or w != w else w)
    assert got.keys() == want.keys()
    for k, (n, by) in want.items():
        best = min(by, key=lambda r: (-round(by[r], 4), r))
        assert (got[k].n_edges, got[k].sum_weight, got[k].top_relation, got[k].top_weight) == (n, pytest.approx(sum(by.values())), best, pytest.approx(by[best]))
    hot = hotkeys.hot_keys(hotkeys.key_totals(df), len(rows), 0.2).collect()
    assert {(r.side, r.entity_id) for r in hot} == {k for k, v in want.items() if v[0] >= 600}


def test_key_totals_of_an_empty_table(spark):
    empty = hotkeys.key_totals(spark.createDataFrame([], EDGE))
    assert empty.count() == 0 and hotkeys.hot_keys(empty, 0).count() == 0


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(rng.randrange(500, 700), rng.randrange(500, 700)) for _ in range(120)] + [(900, 900), (None, 4), (3, 2), (3, 2)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "x long, y long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_month_is_utc_in_any_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        got = spark.range(1).select(orphans.month_of(F.lit(1675209600.0)).alias("m")).first().m
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == "2023-02"

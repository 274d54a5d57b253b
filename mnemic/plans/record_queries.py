"""Queries of the general record operators: orphan references (p2) and heavy keys (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemic.operators import hotkeys, orphans
from mnemic.session import read


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans(*(read(spark, d, t) for t in ("edges", "aliases", "entities", "documents", "tombstones")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "ref_field", "row_id", "period")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.report(_orphans(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    edges = read(spark, d, "edges")
    return hotkeys.hot_keys(hotkeys.key_totals(edges), edges.count()).select("side", "entity_id")


def p5_degree(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.key_totals(read(spark, d, "edges"))


QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p5_found": p5_found, "p5_degree": p5_degree}

_ORPHANS = """
with ref as (
  select 'edges' as table_name, 'head_id' as ref_field, id as row_id, created_at as t, 'entities' as space, cast(head_id as varchar) as k from edges
  union all select 'edges', 'tail_id', id, created_at, 'entities', cast(tail_id as varchar) from edges
  union all select 'edges', 'source', id, created_at, 'documents', trim(lower(split_part(source, '#', 1))) from edges
  union all select 'aliases', 'entity_id', id, created_at, 'entities', cast(entity_id as varchar) from aliases
), parent as (
  select 'entities' as space, cast(id as varchar) as k, min(created_at) as made from entities group by 1, 2
  union all select 'documents', anchor, min(created_at) from documents group by 1, 2
), gone as (
  select r.table_name, r.ref_field, r.row_id from ref r join tombstones d on d.table_name = r.space and d.ref_key = r.k
  where d.deleted_at <= r.t and (d.restored_at is null or d.restored_at > r.t) group by 1, 2, 3
), found as (
  select r.table_name, r.ref_field, r.row_id, strftime(make_timestamp(cast(floor(r.t) * 1000000 as bigint)), '%Y-%m') as period,
    case when p.k is null then 'missing' when p.made > r.t then 'later' when g.row_id is not null then 'deleted' end as reason
  from ref r left join parent p on p.space = r.space and p.k = r.k
  left join gone g on g.table_name = r.table_name and g.ref_field = r.ref_field and g.row_id = r.row_id
  where r.k is not null and r.k <> ''
)"""

_TOTALS = """
with side as (
  select 'head' as side, head_id as entity_id, relation, weight from edges union all select 'tail', tail_id, relation, weight from edges
), rel as (
  select side, entity_id, translate(lower(trim(relation)), ' -', '__') as relation, count(*) as n, sum(weight) as w from side group by 1, 2, 3
), total as (
  select side, entity_id, cast(sum(n) as bigint) as n_edges, round(sum(w), 4) as sum_weight,
    first(relation order by round(w, 4) desc, relation) as top_relation, round(max(w), 4) as top_weight
  from rel group by 1, 2
)"""

ORACLE = {
    "p2_found": _ORPHANS + " select table_name, ref_field, row_id, period from found where reason is not null",
    "p2_report": _ORPHANS + " select table_name, ref_field, period, reason, count(*) as n_refs from found where reason is not null group by 1, 2, 3, 4",
    "p5_found": _TOTALS + " select side, entity_id from total where n_edges >= 0.025 * (select count(*) from edges)",
    "p5_degree": _TOTALS + " select * from total",
}

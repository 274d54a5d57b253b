"""Queries of the llm operators, over whole tables with production parameters, and SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemic.llm import leakage, mixing, neardup, pii, survivors, truncation, variants
from mnemic.session import read


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    return variants.resolved(read(spark, d, "entities"), read(spark, d, "aliases"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return variants.pairs(_resolved(spark, d))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(read(spark, d, "edges")).select("group_id", "keep_id")


def p3_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(read(spark, d, "edges"))


def p3_transitions(spark: SparkSession, d: str) -> DataFrame:
    return survivors.transitions(survivors.groups(survivors.prepare(read(spark, d, "edges"))))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.NearDuplicates(read(spark, d, "documents")).pairs()


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return neardup.NearDuplicates(read(spark, d, "documents")).classes()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.items(read(spark, d, "documents"), read(spark, d, "entities"), read(spark, d, "aliases"))


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(read(spark, d, "documents"), read(spark, d, "entities"), read(spark, d, "aliases"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(read(spark, d, "documents"), read(spark, d, "eval_items")).select("item_id", "doc_id")


def p7_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(read(spark, d, "documents"), read(spark, d, "eval_items"), substitutions=2)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.Truncation(read(spark, d, "documents")).cut().select("doc_id")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.Truncation(read(spark, d, "documents")).rates()


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p3_found, p3_survivors, p3_transitions, p4_found, p4_classes, p6_found, p6_redacted, p7_found, p7_overlaps, p8_mix, p8_shares, p9_found, p9_rates)}

ORACLE = {
    "p3_found": """
with r as (
  select id, head_id, tail_id, translate(lower(trim(relation)), ' -', '__') as rel, created_at,
    case lower(trim(source_type)) when 'operator' then 3 when 'document' then 2 when 'inference' then 1 when 'model' then 0 else 1 end as prec,
    case when confidence >= 0 and confidence <= 1 then confidence + 0.0 else -1 end as conf,
    case when revised_at >= 946684800 and revised_at < 4102444800 then revised_at else -1 end as rev
  from edges where head_id is not null and tail_id is not null and relation is not null
)
select min(id) as group_id, first(id order by prec desc, conf desc, rev desc, created_at desc, id) as keep_id
from r group by head_id, tail_id, rel having count(*) >= 2""",
    "p4_found": r"""
with w as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null),
g as (select distinct doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w)),
n as (select doc_id, count(*) as n from g group by 1),
o as (select a.doc_id as doc_a, b.doc_id as doc_b, count(*) as o from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2)
select doc_a, doc_b from o join n x on x.doc_id = doc_a join n y on y.doc_id = doc_b where o >= 0.6 * (x.n + y.n - o) - 1e-9""",
    "p7_found": r"""
with d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null),
i as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from eval_items where text is not null),
dg as (select distinct doc_id, array_to_string(w[k:k + 11], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as k from d)),
ig as (select distinct item_id, array_to_string(w[k:k + 11], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as k from i))
select distinct item_id, doc_id from ig join dg on ig.g = dg.g""",
}

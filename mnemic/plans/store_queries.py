"""Queries of the graph store and of beliefs, on the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemic import schemas
from mnemic.operators import beliefs as B
from mnemic.operators import substrate as S
from mnemic.operators.hotkeys import canonical_relation
from mnemic.session import materialize, read

#: The present, for decay: a fixed time, so that results repeat.
NOW, HALF_LIFE, FLOOR = 1_722_000_000.0, 30 * 86400.0, 0.05
PERSON = "lower(type) in ('person', 'individual')"


def entity_scan(spark: SparkSession, d: str) -> DataFrame:
    return S.entities_with_surfaces(read(spark, d, "entities"), read(spark, d, "aliases"))


def edge_scan(spark: SparkSession, d: str) -> DataFrame:
    return schemas.conform(read(spark, d, "edges"), "edges").orderBy("id")


def store_counts(spark: SparkSession, d: str) -> DataFrame:
    one = [read(spark, d, t).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t in ("entities", "aliases", "edges", "documents", "hierarchy")]
    out = one[0]
    for x in one[1:]:
        out = out.unionByName(x)
    return out


def surface_lookup(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "aliases")
    return S.resolve(a.select("surface"), read(spark, d, "entities"), a)


def beliefs_active(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "edges").filter("not quarantined and provenance_class = 'real'").select("id", "head_id", canonical_relation(F.col("relation")).alias("relation"), "tail_id")


def node_degree(spark: SparkSession, d: str) -> DataFrame:
    return S.degree(read(spark, d, "edges"))


def neighbours_1hop(spark: SparkSession, d: str) -> DataFrame:
    return S.neighbours(read(spark, d, "edges"), read(spark, d, "entities").filter("layer = 0"))


def hierarchy_links(spark: SparkSession, d: str) -> DataFrame:
    h, e = S.upsert_hierarchy(read(spark, d, "hierarchy")), read(spark, d, "entities")
    name = lambda k: e.select(F.col("id").alias(f"{k}_id"), F.col("canonical").alias(k))
    return h.join(name("parent"), "parent_id", "left").join(name("child"), "child_id", "left").select("id", "parent_id", "parent", "child_id", "child", "layer")


def layer_sizes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "entities").groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


def leaf_graph(spark: SparkSession, d: str) -> DataFrame:
    return S.leaf_graph(read(spark, d, "edges"), read(spark, d, "entities")).select("id", "head_id", "tail_id", "relation", "weight")


def induced_subgraph(spark: SparkSession, d: str) -> DataFrame:
    return S.within(read(spark, d, "edges"), read(spark, d, "entities").filter(PERSON)).select("id", "head_id", "tail_id", "relation")


def candidate_union(spark: SparkSession, d: str) -> DataFrame:
    """Persons, their neighbours, and entities whose name holds a digit (set operations on ids)."""
    e = read(spark, d, "entities")
    seeds = e.filter(PERSON).select("id")
    hop = S.neighbours(read(spark, d, "edges"), e.filter("layer = 0")).join(seeds, "id", "left_semi").select(F.col("neighbour").alias("id"))
    return seeds.union(hop).union(e.filter(F.col("canonical").rlike("[0-9]")).select("id")).distinct()


def isolated_entities(spark: SparkSession, d: str) -> DataFrame:
    """Leaf entities that head no active edge of the real class (set difference on ids)."""
    heads = read(spark, d, "edges").filter("not quarantined and provenance_class = 'real'").select(F.col("head_id").alias("id"))
    return read(spark, d, "entities").filter("layer = 0").select("id").join(heads, "id", "left_anti")


def aliases_missing(spark: SparkSession, d: str) -> DataFrame:
    return S.missing_aliases(read(spark, d, "entities"), read(spark, d, "aliases"))


def docs_for_entities(spark: SparkSession, d: str) -> DataFrame:
    return S.documents_for(read(spark, d, "entities").filter(PERSON), read(spark, d, "edges"), read(spark, d, "documents"))


def entity_upsert(spark: SparkSession, d: str) -> DataFrame:
    log = read(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("canonical"), F.col("p_type").alias("type"), F.col("p_brand").alias("description"))
    return S.upsert_entities(log)


def edge_upsert(spark: SparkSession, d: str) -> DataFrame:
    return S.upsert_edges(read(spark, d, "edges"), canonical_relation(F.col("relation")))


def document_upsert(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return S.upsert_documents(docs.filter("source <> 'mirrorpool'"), docs)


def hierarchy_upsert(spark: SparkSession, d: str) -> DataFrame:
    return S.upsert_hierarchy(read(spark, d, "hierarchy"))


def ensure_entities(spark: SparkSession, d: str) -> DataFrame:
    """Words of relations and event types as surfaces: which of them need an entity."""
    words = read(spark, d, "edges").select(F.col("relation").alias("surface")).union(read(spark, d, "events").select("event_type")).union(read(spark, d, "aliases").select("surface"))
    return S.ensure_entities(words.filter("surface is not null"), read(spark, d, "entities"), read(spark, d, "aliases"))


def belief_patch(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "edges")
    changes = e.filter(B.source_kind(F.col("source_type")) == "model").select("id", F.lit(True).alias("quarantined"), (F.col("charge") + F.col("weight")).alias("charge"))
    return S.patch(e, changes).select("id", "quarantined", F.round("charge", 6).alias("charge"))


def weight_fold(spark: SparkSession, d: str) -> DataFrame:
    up = F.col("event_type").isin("purchase", "signup", "click")
    log = read(spark, d, "events").select("user_id", "ts", "event_id", F.when(up, F.col("value")).otherwise(-F.col("value")).alias("delta"))
    return S.clamped_fold(log.withColumn("delta", F.col("delta") / 10), "user_id", ["ts", "event_id"], 5.0)


def edge_touch(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "edges")
    return S.touched(e, e.filter("revised_at between 0 and 4102444800").select("id", F.col("revised_at").alias("at")))


def edge_decay(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "edges").select("id", F.round(S.decayed(F.col("weight"), F.col("last_used"), F.col("created_at"), NOW, HALF_LIFE, FLOOR), 6).alias("weight"))


def base_weight(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "edges").select("id", canonical_relation(F.col("relation")).alias("relation"))
    return S.running_count(e, "relation", "id").select("id", "tally", F.round(S.base_weight(F.col("tally")), 6).alias("base_weight"))


def hierarchy_cleared(spark: SparkSession, d: str) -> DataFrame:
    parts = S.cleared(read(spark, d, "entities"), read(spark, d, "aliases"), read(spark, d, "edges"))
    out = None
    for name, p in zip(("entities", "aliases", "edges"), parts, strict=True):
        row = p.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("id").alias("sum_ids")).select(F.lit(name).alias("table_name"), "n_rows", "sum_ids")
        out = row if out is None else out.unionByName(row)
    return out


def _beliefs(spark: SparkSession, d: str) -> DataFrame:
    return B.asserted(B.assertions(read(spark, d, "edges")))


def belief_assert(spark: SparkSession, d: str) -> DataFrame:
    b = _beliefs(spark, d)
    return b.select("id", "head_id", "relation", "tail_id", "kind", F.round("confidence", 6).alias("confidence"), "provenance_class", F.round("charge", 6).alias("charge"), "quarantined", "weight")


def belief_recall(spark: SparkSession, d: str) -> DataFrame:
    r = B.recalled(_beliefs(spark, d))
    return r.join(read(spark, d, "entities").select(F.col("id").alias("tail_id"), F.col("canonical").alias("object")), "tail_id", "left").select("head_id", "relation", "tail_id", "object", "score")


def belief_recall_detail(spark: SparkSession, d: str) -> DataFrame:
    return B.recalled(_beliefs(spark, d), provenance=None)


def belief_abstain(spark: SparkSession, d: str) -> DataFrame:
    return B.recalled(_beliefs(spark, d)).groupBy("relation").agg(F.count(F.lit(1)).alias("n_asked"), F.count(F.when(F.col("tail_id").isNull(), 1)).alias("n_abstained"))


def belief_origin(spark: SparkSession, d: str) -> DataFrame:
    return B.origin(_beliefs(spark, d)).withColumn("charge", F.round("charge", 6))


def belief_corroborate(spark: SparkSession, d: str) -> DataFrame:
    """Evidence: every belief that an operator or a document ever stated, with the stronger of the two."""
    log = B.assertions(read(spark, d, "edges"))
    return B.corroborated(_beliefs(spark, d), log.filter("kind in ('operator', 'document')"))


def belief_contradictions(spark: SparkSession, d: str) -> DataFrame:
    return B.contradictions(_beliefs(spark, d))


def belief_consolidate(spark: SparkSession, d: str) -> DataFrame:
    return B.consolidated(materialize(_beliefs(spark, d), "beliefs"))


def belief_revise(spark: SparkSession, d: str) -> DataFrame:
    return B.revised(B.assertions(read(spark, d, "edges")))


def values_guarded(spark: SparkSession, d: str) -> DataFrame:
    return B.guarded(_beliefs(spark, d)).select("head_id", "relation", "tail_id")


QUERIES = {
    f.__name__: f
    for f in (entity_scan, edge_scan, store_counts, surface_lookup, beliefs_active, node_degree, neighbours_1hop, hierarchy_links, layer_sizes, leaf_graph, induced_subgraph, candidate_union, isolated_entities, aliases_missing, docs_for_entities, entity_upsert, edge_upsert, document_upsert, hierarchy_upsert, ensure_entities, belief_patch, weight_fold, edge_touch, edge_decay, base_weight, hierarchy_cleared, belief_assert, belief_recall, belief_recall_detail, belief_abstain, belief_origin, belief_corroborate, belief_contradictions, belief_consolidate, belief_revise, values_guarded)
}

_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REL = "translate(lower(trim(relation)), ' -', '__')"
_RESOLVE = f"""
hit as (select {_FOLD.format('canonical')} as k, 0 as p, id as o, id as e from entities where canonical is not null union all select {_FOLD.format('surface')}, 1, id, entity_id from aliases where surface is not null),
best as (select k, first(e order by p, o, e) as e, min(p) as p from hit group by 1)"""
_KIND = "coalesce(lower(trim(source_type)), '')"
_PREC = "case {0} when 'operator' then 3 when 'document' then 2 when 'inference' then 1 when 'model' then 0 else 1 end"
_CONF = "case {0} when 'operator' then 0.95 when 'document' then 0.8 when 'inference' then 0.5 when 'model' then 0.2 else 0.5 end::double"
_LOG = f"""with log as (select id, head_id, {_REL} as relation, tail_id, {_KIND} as kind,
  case when confidence >= 0 and confidence <= 1 then confidence + 0.0::double else {_CONF.format(_KIND)} end as confidence,
  coalesce(provenance_class, 'real') as provenance_class, greatest(0.0::double, least(1.0::double, coalesce(charge, 0.0::double))) as charge
  from edges where head_id is not null and relation is not null and tail_id is not null)"""
_B = _LOG + f""", b as (select min(id) as id, head_id, relation, tail_id, last(kind order by id) as kind, last(confidence order by id) as confidence, last(provenance_class order by id) as provenance_class,
  last(charge order by id) as charge, last(kind order by id) = 'model' as quarantined, round(case when count(*) = 1 then sum(confidence) else least(sum(confidence), 10) end, 6) as weight from log group by head_id, relation, tail_id),
s as (select *, round({_PREC.format('kind')} + confidence, 9) as score from b)"""


def _recall(where: str) -> str:
    return _B + f""", r as (select head_id, relation, first(tail_id order by score desc, tail_id) filter ({where}) as tail_id, round(max(score) filter ({where}), 6) as score from s group by 1, 2)"""


_NUM = "case when not isnan({0}) then {0} end"
_ACTIVE = "not quarantined and confidence >= 0.35"
_REAL = _ACTIVE + " and provenance_class = 'real'"
_P = "lower(type) in ('person', 'individual')"
_NB = "nb as (select head_id as id, tail_id as neighbour from edges where head_id is not null and tail_id is not null union select tail_id, head_id from edges where head_id is not null and tail_id is not null)"

ORACLE = {
    "entity_scan": "select e.id, canonical, type, layer, surface from entities e left join (select distinct entity_id, surface from aliases) a on a.entity_id = e.id",
    "edge_scan": "select id, head_id, tail_id, relation, coalesce(" + _NUM.format("weight") + ", 1.0) as weight, coalesce(source, '') as source, " + _NUM.format("created_at") + " as created_at, " + _NUM.format("last_used") + " as last_used, coalesce(source_type, 'inference') as source_type, coalesce(" + _NUM.format("confidence") + ", 0.5) as confidence, coalesce(quarantined, false) as quarantined, " + _NUM.format("revised_at") + " as revised_at, coalesce(provenance_class, 'real') as provenance_class, coalesce(" + _NUM.format("charge") + ", 0.0) as charge from edges order by id",
    "store_counts": " union all ".join(f"select '{t}' as table_name, count(*) as n_rows from {t}" for t in ("entities", "aliases", "edges", "documents", "hierarchy")),
    "surface_lookup": f"with {_RESOLVE}, q as (select distinct surface from aliases) select surface, e as entity_id, case p when 0 then 'canonical' when 1 then 'alias' end as via from q left join best on best.k = {_FOLD.format('surface')}",
    "beliefs_active": f"select id, head_id, {_REL} as relation, tail_id from edges where not quarantined and provenance_class = 'real'",
    "node_degree": "select id, count(*) as degree from (select head_id as id from edges union all select tail_id from edges) where id is not null group by 1",
    "neighbours_1hop": f"with {_NB} select nb.id, neighbour from nb join entities e on e.id = neighbour where e.layer = 0",
    "hierarchy_links": "with h as (select min(id) as id, parent_id, child_id, first(layer order by id) as layer from hierarchy group by 2, 3) select h.id, parent_id, p.canonical as parent, child_id, c.canonical as child, h.layer from h left join entities p on p.id = parent_id left join entities c on c.id = child_id",
    "layer_sizes": "select layer, count(*) as n from entities group by 1",
    "leaf_graph": "select id, head_id, tail_id, relation, weight from edges where not coalesce(quarantined, false) and head_id in (select id from entities where layer = 0) and tail_id in (select id from entities where layer = 0)",
    "induced_subgraph": f"select id, head_id, tail_id, relation from edges where head_id in (select id from entities where {_P}) and tail_id in (select id from entities where {_P})",
    "candidate_union": f"with {_NB} select id from entities where {_P} union select neighbour from nb where id in (select id from entities where {_P}) and neighbour in (select id from entities where layer = 0) union select id from entities where regexp_matches(canonical, '[0-9]')",
    "isolated_entities": "select id from entities where layer = 0 and id not in (select head_id from edges where head_id is not null and not quarantined and provenance_class = 'real')",
    "aliases_missing": "select id as entity_id, canonical as surface from entities e where canonical is not null and not exists (select 1 from aliases a where a.entity_id = e.id and a.surface = e.canonical)",
    "docs_for_entities": f"""with p as (select id from entities where {_P}), s as (select distinct trim(lower(split_part(source, '#', 1))) as anchor from edges where trim(source) <> '' and (head_id in (from p) or tail_id in (from p)))
      select doc_id, anchor from documents where anchor in (from s)""",
    "entity_upsert": "select p_name as canonical, min(p_partkey) as id, last(p_type order by p_partkey) as type, last(p_brand order by p_partkey) filter (p_brand <> '') as description, count(*) as n_upserts from part where p_name is not null group by 1",
    "edge_upsert": f"select min(id) as id, head_id, tail_id, {_REL} as relation, round(case when count(*) = 1 then sum(weight) else least(sum(weight), 10) end, 6) as weight, arg_min_null(source, id) as source, arg_min_null(created_at, id) as created_at, count(*) as n_upserts from edges group by 2, 3, 4",
    "document_upsert": "with o as (select anchor, min(doc_id) as doc_id from documents where source <> 'mirrorpool' group by 1) select *, false as is_new from o union all select anchor, first(doc_id order by created_at, doc_id), true from documents where anchor not in (select anchor from o) group by 1",
    "hierarchy_upsert": "select min(id) as id, parent_id, child_id, first(layer order by id) as layer from hierarchy group by 2, 3",
    "ensure_entities": f"with {_RESOLVE}, q as (select relation as surface from edges union select event_type from events union select surface from aliases), n as (select surface, {_FOLD.format('surface')} as k from q where surface is not null) select min(surface) as canonical, count(*) as n_surfaces from n where k not in (select k from best) group by k",
    "belief_patch": f"select id, quarantined or {_KIND} = 'model' as quarantined, round(case when {_KIND} = 'model' then greatest(0.0, least(1.0, charge + weight)) else greatest(0.0, least(1.0, charge)) end, 6) as charge from edges",
    "weight_fold": """select user_id, round(list_reduce(list_prepend(5.0::double, list((case when event_type in ('purchase', 'signup', 'click') then value else -value end / 10)::double order by ts, event_id)), lambda a, x: greatest(least(a + x, 10.0), 0.0)), 6) as value, count(*) as n from events where user_id is not null group by 1""",
    "edge_touch": "select id, case when revised_at between 0 and 4102444800 then revised_at else last_used end as last_used from edges",
    "edge_decay": f"select id, round(greatest({FLOOR}, least(weight * pow(0.5, greatest(0.0, {NOW} - coalesce(last_used, created_at)) / {HALF_LIFE}), 10.0)), 6) as weight from edges",
    "base_weight": f"with r as (select id, row_number() over (partition by {_REL} order by id) - 1 as tally from edges) select id, tally, round(greatest(0.2, 1 - 0.1 * ln(1 + tally)), 6) as base_weight from r",
    "hierarchy_cleared": """with g as (select id from entities where layer > 0)
      select 'entities' as table_name, count(*) as n_rows, sum(id)::bigint as sum_ids from entities where layer = 0 union all select 'aliases', count(*), sum(id)::bigint from aliases where entity_id not in (from g)
      union all select 'edges', count(*), sum(id)::bigint from edges where head_id not in (from g) and tail_id not in (from g)""",
    "belief_assert": _B + " select id, head_id, relation, tail_id, kind, round(confidence, 6) as confidence, provenance_class, round(charge, 6) as charge, quarantined, weight from b",
    "belief_recall": _recall(_REAL) + " select head_id, relation, tail_id, e.canonical as object, score from r left join entities e on e.id = tail_id",
    "belief_recall_detail": _recall(_ACTIVE) + " select * from r",
    "belief_abstain": _recall(_REAL) + " select relation, count(*) as n_asked, count(*) filter (tail_id is null) as n_abstained from r group by 1",
    "belief_origin": _B + " select head_id, relation, tail_id, round(charge, 6) as charge, quarantined from b where provenance_class = 'origin'",
    "belief_corroborate": _B + f""", ev as (select head_id, relation, tail_id, first(kind order by {_PREC.format('kind')} desc) as ek from log where kind in ('operator', 'document') group by 1, 2, 3)
      select b.id, b.head_id, b.relation, b.tail_id, case when ek is not null and quarantined and {_PREC.format('ek')} > {_PREC.format('kind').replace('else 1', 'else 0')} then ek else kind end as kind,
      round(case when ek is not null and quarantined then greatest(confidence, {_CONF.format('ek')}) when ek is not null then least(1.0, confidence + 0.1) else confidence end, 6) as confidence, quarantined and ek is null as quarantined, ek is not null as changed
      from b left join ev on ev.head_id = b.head_id and ev.relation = b.relation and ev.tail_id = b.tail_id""",
    "belief_contradictions": _B + " select head_id, relation, count(distinct tail_id) as n_objects, count(*) as n_beliefs from b where not quarantined group by 1, 2 having count(distinct tail_id) > 1",
    "belief_consolidate": _B + """, t as (select head_id, relation, first(tail_id order by score desc, tail_id) as keep from s where not quarantined group by 1, 2),
      x as (select s.*, not quarantined and tail_id <> keep as demoted from s left join t on t.head_id = s.head_id and t.relation = s.relation)
      select id, head_id, relation, tail_id, kind, case when demoted then 0.05 else round(confidence, 6) end as confidence, quarantined or coalesce(demoted, false) as quarantined, demoted from x""",
    "values_guarded": _B + " select head_id, relation, tail_id from b where not quarantined and kind = 'operator'",
    "belief_revise": _LOG.replace("with log", "with recursive log") + f""", o as (select *, row_number() over (partition by head_id, relation order by id) as rn, {_PREC.format('kind')} as p from log),
  st(head_id, relation, rn, tail_id, kind, confidence, flips, held, reinforced) as (
    select head_id, relation, 0::bigint, null::bigint, null::varchar, 0.0::double, 0::bigint, 0::bigint, 0::bigint from o where rn = 1
    union all
    select o.head_id, o.relation, o.rn, case when act then o.tail_id else st.tail_id end, case when act or same then o.kind else st.kind end,
      case when same then least(1.0, greatest(st.confidence, o.confidence)) when act then o.confidence else st.confidence end, flips + act::int, held + (not act and not same)::int, reinforced + same::int
    from st join o on o.head_id = st.head_id and o.relation = st.relation and o.rn = st.rn + 1,
      lateral (select st.tail_id is not null and st.tail_id = o.tail_id as same) a,
      lateral (select not same and case when st.tail_id is null then o.kind <> 'model' else o.p > {_PREC.format('st.kind')} or (o.p = {_PREC.format('st.kind')} and o.confidence >= st.confidence - 0.1) end as act) b)
  select head_id, relation, last(tail_id order by rn) as tail_id, last(kind order by rn) as kind, round(last(confidence order by rn), 6) as confidence, max(flips) as flips, max(held) as held, max(reinforced) as reinforced from st group by 1, 2""",
}

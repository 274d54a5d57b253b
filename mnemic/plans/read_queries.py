"""Queries of planning, addressing, composition, hierarchy, writing and feedback.

The stated queries are the eval items whose id is divisible by 50.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemic.functions import vectors as V
from mnemic.operators import addressing as A
from mnemic.operators import compose as C
from mnemic.operators import feedback as Fb
from mnemic.operators import hierarchy as H
from mnemic.operators import planner as P
from mnemic.operators import substrate as S
from mnemic.operators import writer as W
from mnemic.operators.hotkeys import canonical_relation
from mnemic.session import materialize, read

TOP = 8


def _items(spark: SparkSession, d: str, stated: bool = True) -> DataFrame:
    q = read(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "text")
    return q.filter("query_id % 50 = 0") if stated else q


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "entities").select("id", V.text_hv(F.col("canonical")).alias("hv")).filter("hv is not null")


def plan_queries(spark: SparkSession, d: str) -> DataFrame:
    p = P.plans(_items(spark, d, stated=False))
    join = lambda c: F.array_join(c, "|")
    return p.select("query_id", join("mentions").alias("mentions"), join("aliases").alias("aliases"), join("relation_cues").alias("relation_cues"), join("constraints").alias("constraints"), "target_type", "intent", F.size("probes").alias("n_probes"))


def plan_probes(spark: SparkSession, d: str) -> DataFrame:
    return P.probes(P.plans(_items(spark, d, stated=False)))


def _channels(spark: SparkSession, d: str, semantic: bool) -> DataFrame:
    return A.channels(P.plans(_items(spark, d)), read(spark, d, "entities"), read(spark, d, "aliases"), semantic)


def address_channels(spark: SparkSession, d: str) -> DataFrame:
    c = _channels(spark, d, semantic=False)
    return c.select("query_id", "id", *[F.round(x, 6).alias(x) for x in A.WEIGHTS])


def address_softmax(spark: SparkSession, d: str) -> DataFrame:
    a = A.activations(materialize(_channels(spark, d, semantic=False), "channels"))
    return a.select("query_id", "id", "score", "activation")


def _top(spark: SparkSession, d: str, semantic: bool) -> DataFrame:
    """The strongest entities from sparse scores."""
    e, plans = read(spark, d, "entities"), P.plans(_items(spark, d))
    leaf = e.filter("layer = 0").select("id")
    n = leaf.count()
    acts = materialize(A.activations(A.channels(plans, e, read(spark, d, "aliases"), semantic, dense=False), rest=n), "activations")
    return A.filled(A.top_k(acts, TOP), acts, plans, leaf, n, TOP)


def address_topk(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, False)


def address_semantic(spark: SparkSession, d: str) -> DataFrame:
    """Top entities with the semantic channel of hashed text vectors added."""
    return _top(spark, d, True)


def _active(spark: SparkSession, d: str) -> DataFrame:
    """Per relation the 50 entities with most edges, with their share of the largest degree as activation;
    the relation's name is the query."""
    e = read(spark, d, "edges").filter("not quarantined").select(F.xxhash64(canonical_relation(F.col("relation"))).alias("query_id"), canonical_relation(F.col("relation")).alias("relation"), "head_id", "tail_id")
    deg = e.select("relation", F.explode(F.array("head_id", "tail_id")).alias("id")).join(_vectors(spark, d).select("id"), "id", "left_semi").groupBy("relation", "id").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql.window import Window

    top = deg.withColumn("r", F.row_number().over(Window.partitionBy("relation").orderBy(F.desc("n"), "id"))).filter("r <= 50")
    most = deg.groupBy("relation").agg(F.max("n").alias("m"))
    return top.join(most, "relation").select(F.col("relation").alias("query_id"), "id", F.round(F.col("n") / F.col("m"), 6).alias("activation"))


def _paths(spark: SparkSession, d: str) -> DataFrame:
    # an entity set is activated per relation, and its subgraph holds the edges of that relation
    e = read(spark, d, "edges").filter("not quarantined").select("id", "head_id", "tail_id", canonical_relation(F.col("relation")).alias("relation"), "weight")
    return materialize(C.paths(e.withColumn("query_id", F.col("relation")), _active(spark, d), _vectors(spark, d)), "paths")


def compose_subgraph(spark: SparkSession, d: str) -> DataFrame:
    return C.composed(_paths(spark, d)).select("query_id", "pos", "s", "n", "x")


def attribute_paths(spark: SparkSession, d: str) -> DataFrame:
    p = _paths(spark, d)
    return C.path_similarity(p, materialize(C.composed(p), "composed"))


def attribute_loo(spark: SparkSession, d: str) -> DataFrame:
    p = _paths(spark, d)
    return C.leave_one_out(p, materialize(C.composed(p), "composed"))


def parent_bundle(spark: SparkSession, d: str) -> DataFrame:
    return H.parent_bundles(read(spark, d, "hierarchy"), _vectors(spark, d)).select("parent_id", "pos", "s", "n", "x")


def centroid_child(spark: SparkSession, d: str) -> DataFrame:
    return H.centroid_children(read(spark, d, "hierarchy"), _vectors(spark, d))


def rollup_edges(spark: SparkSession, d: str) -> DataFrame:
    return H.rollup(read(spark, d, "edges").filter("not quarantined"), read(spark, d, "hierarchy"))


def hierarchy_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return H.ancestors(read(spark, d, "hierarchy"))


def _route(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    q = _items(spark, d).select("query_id", V.text_hv(F.col("text")).alias("hv"))
    return H.route(q, read(spark, d, "entities"), read(spark, d, "hierarchy"), _vectors(spark, d))


def route_beam(spark: SparkSession, d: str) -> DataFrame:
    return _route(spark, d)[0]


def route_touched(spark: SparkSession, d: str) -> DataFrame:
    return _route(spark, d)[1]


def hierarchy_build(spark: SparkSession, d: str) -> DataFrame:
    from mnemic.plans.graph_queries import leaves
    from mnemic.operators.roles import collapsed_sum

    e = read(spark, d, "entities").filter("layer = 0").select("id", "canonical")
    parents, tree = H.build(e, materialize(collapsed_sum(leaves(spark, d)), "pairs"), _vectors(spark, d))
    return parents.join(tree.groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("n_children")), "id").select("id", "canonical", "layer", "n_children")


def cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return W.cooccurrences(read(spark, d, "documents"))


def ingest_triples(spark: SparkSession, d: str) -> DataFrame:
    return W.ingested(read(spark, d, "documents"))


def udtf_triples(spark: SparkSession, d: str) -> DataFrame:
    """The table function over the test items."""
    spark.udtf.register("extract_triples", W.ExtractTriples)
    read(spark, d, "eval_items").createOrReplaceTempView("mnemic_items")
    return spark.sql("select item_id, t.head, t.relation, t.tail from mnemic_items, lateral extract_triples(text) t")


def _retrieved(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Per relation: documents its edges name, and among them as gold those that an operator vouched for."""
    e = read(spark, d, "edges").select(canonical_relation(F.col("relation")).alias("query_id"), F.trim(F.lower(F.substring_index("source", "#", 1))).alias("key"), "source_type", "weight").filter("key <> ''")
    return e.filter("weight >= 1").select("query_id", "key"), e.filter("lower(trim(source_type)) = 'operator'").select("query_id", "key")


def reward_signals(spark: SparkSession, d: str) -> DataFrame:
    return Fb.rewards(*_retrieved(spark, d))


def writer_update(spark: SparkSession, d: str) -> DataFrame:
    """Reinforcement after a reward of 0.8 with persons as gold entities."""
    e = read(spark, d, "edges")
    gold = read(spark, d, "entities").filter("lower(type) in ('person', 'individual')").select("id")
    return W.reinforced(e, Fb.edge_rewards(e, gold, 0.8), 1_722_000_000.0)


def recall_lines(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, line_no, line): at most TOP lines of recalled memory per query, documents of the active
    entities before relations between them."""
    from pyspark.sql.window import Window

    top = materialize(_top(spark, d, semantic=False), "top").select("query_id", "id")
    e = read(spark, d, "edges").filter("not quarantined")
    ends = e.select("id", F.explode(F.array("head_id", "tail_id")).alias("end"), F.trim(F.lower(F.substring_index("source", "#", 1))).alias("anchor")).filter("anchor <> ''")
    docs = ends.join(top.withColumnRenamed("id", "end"), "end").select("query_id", "anchor").distinct().join(read(spark, d, "documents").select("anchor", "doc_id", "text").filter("text <> ''"), "anchor")
    doc_lines = docs.select("query_id", F.lit(0).alias("p"), F.col("doc_id").alias("o"), F.concat(F.lit("- ("), "anchor", F.lit(") "), F.trim("text")).alias("line"))
    name = lambda k: read(spark, d, "entities").select(F.col("id").alias(k), F.col("canonical").alias(f"{k}_name"))
    inner = e.join(top.select("query_id", F.col("id").alias("head_id")), "head_id").join(top.select("query_id", F.col("id").alias("tail_id")), ["query_id", "tail_id"]).join(name("head_id"), "head_id").join(name("tail_id"), "tail_id")
    rel_lines = inner.select("query_id", F.lit(1).alias("p"), F.col("id").alias("o"), F.concat_ws(" ", F.lit("-"), "head_id_name", canonical_relation(F.col("relation")), "tail_id_name").alias("line"))
    w = Window.partitionBy("query_id").orderBy("p", "o")
    return doc_lines.unionByName(rel_lines).withColumn("line_no", F.row_number().over(w)).filter(F.col("line_no") <= TOP).select("query_id", "line_no", "line")


QUERIES = {
    f.__name__: f
    for f in (plan_queries, plan_probes, address_channels, address_softmax, address_topk, address_semantic, compose_subgraph, attribute_paths, attribute_loo, parent_bundle, centroid_child, rollup_edges, hierarchy_ancestors, route_beam, route_touched, hierarchy_build, cooccurrence, ingest_triples, udtf_triples, reward_signals, writer_update, recall_lines)
}

_STOP = "[" + ", ".join(f"'{w}'" for w in P.STOP) + "]"
_VERBS = "[" + ", ".join(f"'{w}'" for w in P.VERBS) + "]"
_REL = "translate(lower(trim(relation)), ' -', '__')"


def _distinct(x: str) -> str:
    """Distinct list elements in order of first appearance."""
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


def _has(words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains(low, '{w}')" for w in words) + ")"


_TARGET = "case " + " ".join(f"when starts_with(low, '{c} ') or contains(low, ' {c} ') then '{t}'" for c, t in P.QUESTIONS.items()) + " end"
_PLAN = f"""with t as (select item_id as query_id, text, lower(text) as low, regexp_extract_all(text, '{P.SPAN}') as m0, regexp_extract_all(lower(text), '{P.WORDS}') as w0 from eval_items),
u as (select *, {_distinct('m0')} as mentions, {_distinct('w0')} as words from t),
plan as (select query_id, text, mentions, list_filter(words, lambda w: length(w) > 2 and not list_contains({_STOP}, w) and not list_contains(list_transform(mentions, lambda m: lower(m)), w)) as aliases,
  list_filter(words, lambda w: list_contains({_VERBS}, w)) as relation_cues, regexp_extract_all(text, '{P.NUMBERS}') as constraints, {_TARGET} as target_type,
  case when {_has(P.ASSOCIATION)} then 'association' when {_has(P.BRIDGE)} then 'bridge' else 'lookup' end as intent,
  list_filter(list_transform(regexp_extract_all(text, '{P.SENTENCE}'), lambda s: trim(s)), lambda s: s <> '') as probes from u)"""
_ADDRESS = _PLAN + """, q as (select query_id, list_transform(mentions, lambda m: lower(m)) as es, list_distinct(list_concat(list_transform(mentions, lambda m: lower(m)), aliases)) as al, constraints as hard, target_type from plan where query_id % 50 = 0),
leaf as (select id, lower(canonical) as canon, lower(coalesce(description, '')) as descr, lower(coalesce(type, '')) as kind from entities where layer = 0),
surf as (select id, canon as s from leaf union select l.id, lower(surface) from aliases a join leaf l on l.id = a.entity_id),
qm as (select query_id, unnest(es) as m from q), qa as (select query_id, unnest(al) as a from q),
cw as (select id, canon, list_distinct(list_filter(regexp_split_to_array(canon, '\\s+'), lambda w: w <> '')) as w from leaf),
mw as (select query_id, m, list_distinct(list_filter(regexp_split_to_array(m, '\\s+'), lambda w: w <> '')) as w from qm),
jac as (select query_id, id, case when m = canon then 1.0 else len(list_intersect(cw.w, mw.w)) / len(list_distinct(list_concat(cw.w, mw.w))) end::double as j from cw, mw),
ex as (select query_id, id, max(case when j >= 0.6 then j else 0 end) as exact from jac group by 1, 2),
pre as (select query_id, id, s, a, case when s = a then 1.0 when contains(s, a) or contains(a, s) then 0.5 else 0 end as alias, 
  coalesce(list_max(list_filter(range(1, least(length(s), length(a)) + 1), lambda i: s[1:i] = a[1:i])), 0) / greatest(length(s), length(a)) as r from surf, qa where s <> ''),
al as (select query_id, id, max(alias)::double as alias, max(case when r >= 0.5 then r else 0 end)::double as entity_link from pre group by 1, 2),
ch as (select q.query_id, leaf.id, coalesce(exact, 0) as exact, coalesce(alias, 0) as alias, 0.0::double as semantic, coalesce((kind = target_type)::int, 0)::double as type,
  coalesce(list_bool_or(list_transform(hard, lambda h: contains(canon, h) or contains(descr, h))), false)::int::double as constraint, coalesce(entity_link, 0) as entity_link
  from q cross join leaf left join ex on ex.query_id = q.query_id and ex.id = leaf.id left join al on al.query_id = q.query_id and al.id = leaf.id),
sc as (select query_id, id, exact * 3.0 + alias * 2.0 + semantic * 1.5 + type * 1.0 + "constraint" * 0.75 + entity_link * 1.25 as score from ch),
sm as (select query_id, id, score, exp((score - max(score) over (partition by query_id)) / 0.5) as e from sc),
act as (select query_id, id, round(score, 6) as score, round(e / sum(e) over (partition by query_id), 9) as activation from sm)"""


def _hv(text: str) -> str:
    return f"list_transform(range(1, 33), lambda i: case when strpos('0123456789abcdef', md5('0:' || {text})[i:i]) - 1 < 6 then -1 when strpos('0123456789abcdef', md5('0:' || {text})[i:i]) - 1 < 10 then 0 else 1 end)"


_HV = f"hv as (select id, {_hv('canonical')} as hv from entities where canonical is not null), he as (select id, unnest(range(32))::int as pos, unnest(hv) as x from hv)"
_PATHS = f"""with {_HV}, e as (select id as edge_id, head_id, tail_id, {_REL} as relation, weight from edges where not quarantined),
deg as (select relation, id, count(*) as n from (select relation, head_id as id from e union all select relation, tail_id from e) where id in (select id from hv) group by 1, 2),
act as (select relation, id, round(n / max(n) over (partition by relation), 6) as a from deg qualify row_number() over (partition by relation order by n desc, id) <= 50),
j as (select e.relation as query_id, edge_id, head_id as u, e.relation, tail_id as v, greatest(0.0, a.a * b.a) * coalesce(weight, 0) as w from e join act a on a.relation = e.relation and a.id = head_id join act b on b.relation = e.relation and b.id = tail_id),
pt as (select *, greatest(1, round_even(round(w / sum(w) over (partition by query_id) * greatest(8, count(*) over (partition by query_id)), 9), 0)::int) as copies from j),
rh as (select relation, unnest(range(32))::int as pos, unnest({_hv("'relation:' || relation")}) as x from (select distinct relation from e)),
pe as (select query_id, edge_id, u, v, copies, hu.pos, hu.x * r.x * hv2.x as x from pt join he hu on hu.id = u join rh r on r.relation = pt.relation and r.pos = hu.pos join he hv2 on hv2.id = v and hv2.pos = hu.pos),
whole as (select query_id, pos, sum(x * copies)::bigint as s, sum(copies)::bigint as n, case when abs(sum(x * copies)) <= 0.5 * sqrt(sum(copies)) then 0 else sign(sum(x * copies))::int end as x from pe group by 1, 2)"""
_BUNDLE = f"""with recursive {_HV}, l as (select distinct parent_id, child_id from hierarchy),
pb as (select parent_id, pos, sum(x)::bigint as s, count(*) as n, case when abs(sum(x)) <= 0.5 * sqrt(count(*)) then 0 else sign(sum(x))::int end as x from l join he on he.id = child_id group by 1, 2)"""


def _kept(layer: int, found: str, width: int) -> str:
    return f"""k{layer} as (select query_id, {layer} as layer, id, similarity from (select f.query_id, f.id, round(coalesce(sum(h.x * q.x) / nullif(sum(abs(h.x * q.x)), 0), 0), 6) as similarity from {found} f join he h on h.id = f.id join qe q on q.query_id = f.query_id and q.pos = h.pos group by 1, 2)
      qualify row_number() over (partition by query_id order by similarity desc, id) <= {width})"""


_ROUTE = _BUNDLE + f""", q as (select item_id as query_id, {_hv('text')} as hv from eval_items where item_id % 50 = 0), qe as (select query_id, unnest(range(32))::int as pos, unnest(hv) as x from q),
f2 as (select query_id, id from q, entities where layer = 2), {_kept(2, 'f2', 3)}, f1 as (select distinct query_id, child_id as id from k2 join l on l.parent_id = k2.id), {_kept(1, 'f1', 3)},
f0 as (select distinct query_id, child_id as id from k1 join l on l.parent_id = k1.id), {_kept(0, 'f0', 12)}"""

ORACLE = {
    "plan_queries": _PLAN + " select query_id, array_to_string(mentions, '|') as mentions, array_to_string(aliases, '|') as aliases, array_to_string(relation_cues, '|') as relation_cues, array_to_string(constraints, '|') as constraints, target_type, intent, len(probes)::int as n_probes from plan",
    "plan_probes": _PLAN + " select query_id, unnest(range(len(probes)))::int as probe_no, unnest(probes) as text, 1.0::double as weight from plan union all select query_id, unnest(range(len(mentions)))::int, unnest(mentions), 0.5 from plan",
    "address_channels": _ADDRESS + ' select query_id, id, round(exact, 6) as exact, alias, semantic, type, "constraint", round(entity_link, 6) as entity_link from ch',
    "address_softmax": _ADDRESS + " select query_id, id, score, activation from act",
    "address_topk": _ADDRESS + " select query_id, rank, id, activation from (select *, row_number() over (partition by query_id order by activation desc, id)::int as rank from act) where rank <= 8",
    "compose_subgraph": _PATHS + " select * from whole",
    "attribute_paths": _PATHS + " select pe.query_id, edge_id, round(coalesce(sum(pe.x * w.x) / nullif(sum(abs(pe.x * w.x)), 0), 0), 6) as similarity from pe join whole w on w.query_id = pe.query_id and w.pos = pe.pos group by 1, 2",
    "attribute_loo": _PATHS + """, own as (select query_id, 'entity' as level, u as key, pos, x * copies as s, copies as n from pe union all select query_id, 'entity', v, pos, x * copies, copies from pe where u <> v union all select query_id, 'edge', edge_id, pos, x * copies, copies from pe),
      part as (select query_id, level, key, pos, sum(s) as ps, sum(n) as pn from own group by 1, 2, 3, 4),
      r as (select part.query_id, level, key, w.x as c, case when w.n <= pn then 0 when abs(w.s - ps) <= 0.5 * sqrt(w.n - pn) then 0 else sign(w.s - ps)::int end as r from part join whole w on w.query_id = part.query_id and w.pos = part.pos),
      wo as (select query_id, level, key, round(coalesce(sum(r * c) / nullif(sum(abs(r * c)), 0), 0), 6) as without from r group by 1, 2, 3), b as (select query_id, max(abs(x)) as base from whole group by 1)
      select wo.query_id, level, key, round(base - without, 6) as importance from wo join b on b.query_id = wo.query_id""",
    "parent_bundle": _BUNDLE + " select * from pb",
    "centroid_child": _BUNDLE + """, s as (select l.parent_id, l.child_id, round(coalesce(sum(he.x * pb.x) / nullif(sum(abs(he.x * pb.x)), 0), 0), 6) as similarity from l join he on he.id = l.child_id join pb on pb.parent_id = l.parent_id and pb.pos = he.pos group by 1, 2)
      select * from s qualify row_number() over (partition by parent_id order by similarity desc, child_id) = 1""",
    "rollup_edges": """with up as (select child_id, min(parent_id) as p from hierarchy group by 1)
      select least(h.p, t.p) as head_id, greatest(h.p, t.p) as tail_id, '__summary_L1__' as relation, round(least(sum(weight), 10), 6) as weight from edges join up h on h.child_id = head_id join up t on t.child_id = tail_id where not quarantined and h.p <> t.p group by 1, 2""",
    "hierarchy_ancestors": "with recursive l as (select distinct parent_id, child_id from hierarchy where parent_id <> child_id), a(id, ancestor_id, depth) as (select child_id, parent_id, 1 from l union select a.id, l.parent_id, depth + 1 from a join l on l.child_id = a.ancestor_id where depth < 64) select id, ancestor_id, min(depth) as depth from a group by 1, 2",
    "route_beam": _ROUTE + " select * from k2 union all select * from k1 union all select * from k0",
    "route_touched": _ROUTE + ", t as (select query_id, count(*) as touched from (select * from f2 union all select * from f1 union all select * from f0) group by 1) select query_id, touched, round(touched / (select count(*) from entities where layer = 0), 6) as touch_fraction from t",
    "cooccurrence": f"""with t as (select doc_id, text, regexp_extract_all(text, '{P.SPAN}') as m0 from documents where text is not null),
      c as (select doc_id, list_filter({_distinct('m0')}, lambda c: length(c) > 2 and not list_contains({_STOP}, lower(c))) as c, unnest(regexp_extract_all(text, '{P.SENTENCE}')) as s from t),
      p as (select doc_id, list_filter(c, lambda x: contains(s, x))[1:2] as t from c) select t[1] as head, t[2] as tail, count(*) as n_sentences, count(distinct doc_id) as n_docs from p where len(t) = 2 group by 1, 2""",
    "reward_signals": f"""with e as (select {_REL} as query_id, trim(lower(split_part(source, '#', 1))) as key, source_type, weight from edges), r as (select distinct query_id, key from e where key <> '' and weight >= 1), g as (select distinct query_id, key from e where key <> '' and lower(trim(source_type)) = 'operator'),
      a as (select coalesce(r.query_id, g.query_id) as query_id, count(r.key) as n_retrieved, count(g.key) as n_gold, count(*) filter (r.key is not null and g.key is not null) as n_hit from r full join g on g.query_id = r.query_id and g.key = r.key group by 1),
      b as (select *, coalesce(n_hit / nullif(n_gold, 0), 0) as rec, case when n_gold > 0 and n_retrieved > 0 then n_hit / n_retrieved else 0 end as pre, (n_hit > 0)::int::double as deductive from a)
      select query_id, n_retrieved, n_gold, n_hit, round(rec, 6) as recall, round(pre, 6) as precision, deductive, 0.0::double as repetition, 0.0::double as format, round((rec + 0.5 * pre + deductive) / 2.5, 6) as task, round((rec + 0.5 * pre + deductive) / 2.5, 6) as total from b""",
    "writer_update": """with g as (select id from entities where lower(type) in ('person', 'individual')), e as (select *, case when head_id in (from g) or tail_id in (from g) then 0.8 else -0.4 end as r from edges)
      select id, round(greatest(0.0, least(10.0, weight + case when r >= 0 then 0.5 * r else 0.25 * r end)), 6) as weight, case when r >= 0 then 1722000000.0::double else last_used end as last_used from e""",
    "recall_lines": _ADDRESS + f""", tp as (select query_id, id from act qualify row_number() over (partition by query_id order by activation desc, id) <= 8), e as (select * from edges where not quarantined),
      en as (select head_id as id, trim(lower(split_part(source, '#', 1))) as anchor from e union select tail_id, trim(lower(split_part(source, '#', 1))) from e),
      dl as (select distinct query_id, 0 as p, doc_id as o, '- (' || anchor || ') ' || trim(text) as line from tp join en on en.id = tp.id join documents d using (anchor) where anchor <> '' and text <> ''),
      rl as (select a.query_id, 1 as p, e.id as o, concat_ws(' ', '-', h.canonical, {_REL}, t.canonical) as line from e join tp a on a.id = head_id join tp b on b.id = tail_id and b.query_id = a.query_id join entities h on h.id = head_id join entities t on t.id = tail_id)
      select query_id, row_number() over (partition by query_id order by p, o)::int as line_no, line from (select * from dl union all select * from rl) qualify line_no <= 8""",
}

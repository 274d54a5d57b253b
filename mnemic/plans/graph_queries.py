"""Queries of structural measures and communities on the leaf graph of the edges table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemic.operators import communities as C
from mnemic.operators import roles as R
from mnemic.operators import substrate as S
from mnemic.operators.components import components
from mnemic.session import materialize, read


def leaves(spark: SparkSession, d: str) -> DataFrame:
    e = S.leaf_graph(read(spark, d, "edges"), read(spark, d, "entities"))
    return materialize(e.select("id", "head_id", "tail_id", "weight"), "leaf-graph")


def edge_collapse_max(spark: SparkSession, d: str) -> DataFrame:
    return R.collapsed_max(leaves(spark, d))


def edge_collapse_sum(spark: SparkSession, d: str) -> DataFrame:
    return R.collapsed_sum(leaves(spark, d))


def clustering_coeff(spark: SparkSession, d: str) -> DataFrame:
    return R.clustering(materialize(R.pairs(leaves(spark, d)), "pairs"))


def neighbour_degree(spark: SparkSession, d: str) -> DataFrame:
    return R.neighbour_degree(R.pairs(leaves(spark, d)))


def core_numbers(spark: SparkSession, d: str) -> DataFrame:
    return R.cores(R.pairs(leaves(spark, d)))


def edge_features(spark: SparkSession, d: str) -> DataFrame:
    return R.edge_features(materialize(R.pairs(leaves(spark, d)), "pairs"))


def weighted_degree(spark: SparkSession, d: str) -> DataFrame:
    return R.weighted_degree(leaves(spark, d))


def node_features(spark: SparkSession, d: str) -> DataFrame:
    f = R.node_features(leaves(spark, d))
    return f.select("id", *[F.round(c, 6).alias(c) for c in f.columns if c != "id"])


def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    e = leaves(spark, d)
    return R.graph_summary(R.node_features(e), e)


def betweenness(spark: SparkSession, d: str) -> DataFrame:
    return R.betweenness(materialize(R.pairs(leaves(spark, d)), "pairs"))


def structural_roles(spark: SparkSession, d: str) -> DataFrame:
    counted = materialize(R.counted_pairs(S.leaf_graph(read(spark, d, "edges"), read(spark, d, "entities"))), "counted-pairs")
    p = counted.filter("a <> b").select("a", "b")
    degree = counted.select(F.explode(F.array("a", "b")).alias("id"), "n").groupBy("id").agg(F.sum("n").alias("degree"))
    # one after the other: together, both hold their files and memory at once, and a broadcast may wait for the other's tasks
    between = materialize(R.betweenness(p), "betweenness")
    clustered = materialize(R.clustering(p).select("id", "clustering"), "clustering")
    return degree.withColumn("log_degree", F.round(F.log1p("degree"), 6)).join(clustered, "id", "left").join(between, "id", "left").fillna(0.0)


def graph_components(spark: SparkSession, d: str) -> DataFrame:
    return components(R.pairs(leaves(spark, d)))


def _communities(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = materialize(R.collapsed_sum(leaves(spark, d)), "pairs")
    return p, materialize(C.communities(p, read(spark, d, "entities").filter("layer = 0").select("id")), "communities")


def graph_communities(spark: SparkSession, d: str) -> DataFrame:
    return _communities(spark, d)[1]


def community_modularity(spark: SparkSession, d: str) -> DataFrame:
    return C.modularity(*_communities(spark, d))


QUERIES = {f.__name__: f for f in (edge_collapse_max, edge_collapse_sum, clustering_coeff, neighbour_degree, core_numbers, edge_features, weighted_degree, node_features, graph_summary, betweenness, structural_roles, graph_components, graph_communities, community_modularity)}

LEAF = "with recursive leaf as (select id, head_id, tail_id, weight from edges where not coalesce(quarantined, false) and head_id in (select id from entities where layer = 0) and tail_id in (select id from entities where layer = 0))"
_PAIRS = LEAF + ", p as (select distinct least(head_id, tail_id) as a, greatest(head_id, tail_id) as b from leaf where head_id <> tail_id), w as (select a, b from p union all select b, a from p), deg as (select a as id, count(*) as degree from w group by 1)"
_TRI = _PAIRS + ", tri as (select p.a as x, p.b as y, q.b as z from p join p q on q.a = p.b join p r on r.a = p.a and r.b = q.b)"
_CLUSTER = _TRI + """, tn as (select unnest([x, y, z]) as id from tri), t as (select id, count(*) as n from tn group by 1),
  cl as (select deg.id, degree, coalesce(n, 0) as triangles, round(case when degree > 1 then 2 * coalesce(n, 0) / (degree * (degree - 1)) else 0 end, 6) as clustering from deg left join t on t.id = deg.id)"""
_MAX = LEAF + ", c as (select head_id as src, tail_id as dst, max(weight) as weight from leaf where head_id <> tail_id group by 1, 2)"

ORACLE = {
    "edge_collapse_max": _MAX + " select * from c",
    "edge_collapse_sum": LEAF + " select least(head_id, tail_id) as a, greatest(head_id, tail_id) as b, round(sum(weight), 6) as weight from leaf where head_id <> tail_id group by 1, 2",
    "clustering_coeff": _CLUSTER + " select * from cl",
    "neighbour_degree": _PAIRS + " select w.a as id, round(avg(degree), 6) as mean_neighbour_degree from w join deg on deg.id = w.b group by 1",
    "edge_features": _TRI + """, c as (select a, b, count(*) as n from (select x as a, y as b from tri union all select y, z from tri union all select x, z from tri) group by 1, 2)
      select p.a, p.b, round(abs(ln(1 + da.degree) - ln(1 + db.degree)), 6) as degree_gap, coalesce(n, 0) as common, round(coalesce(n, 0) / (da.degree + db.degree - coalesce(n, 0)), 6) as jaccard from p left join c on c.a = p.a and c.b = p.b join deg da on da.id = p.a join deg db on db.id = p.b""",
    "weighted_degree": _MAX + " select id, round(greatest(sum(weight), 1e-8), 6) as strength from (select src as id, weight from c union all select dst, weight from c) group by 1",
    "graph_components": _PAIRS + """, reach(id, root) as (select a, a from w union select w.b, least(r.root, w.b) from reach r join w on w.a = r.id where least(r.root, w.b) <> w.b or r.root = w.b)
      select id, min(root) as component from reach group by 1""",
}

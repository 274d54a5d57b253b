"""Abstraction hierarchy: parent bundles, edge rollup, closure, building by communities, beam routing."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemic.functions import vectors as V
from mnemic.functions.kernels import Digest, Kernel
from mnemic.operators.communities import communities
from mnemic.schemas import MAX_WEIGHT
from mnemic.session import materialize

DIGEST = Digest()
#: Queries that are held against a layer at a time.
BLOCK = 1000


def links(hierarchy: DataFrame) -> DataFrame:
    return hierarchy.select("parent_id", "child_id").dropna().distinct()


def parent_bundles(hierarchy: DataFrame, vectors: DataFrame, kernel: Kernel = DIGEST) -> DataFrame:
    """(parent_id, pos, s, n, x): bundle of each parent's children; children without a vector are zeros."""
    j = links(hierarchy).join(vectors.select(F.col("id").alias("child_id"), "hv"), "child_id")
    return kernel.bundle(j.select("parent_id", "hv"), ["parent_id"])


def centroid_children(hierarchy: DataFrame, vectors: DataFrame, kernel: Kernel = DIGEST) -> DataFrame:
    """(parent_id, child_id, similarity): the child most similar to its parent's bundle, ties to the smaller id."""
    b = V.assembled(parent_bundles(hierarchy, vectors, kernel), ["parent_id"]).withColumnRenamed("hv", "p_hv")
    j = links(hierarchy).join(vectors.select(F.col("id").alias("child_id"), "hv"), "child_id").join(b, "parent_id")
    s = j.select("parent_id", "child_id", F.round(kernel.similarity(F.col("hv"), F.col("p_hv")), 6).alias("similarity"))
    best = s.groupBy("parent_id").agg(F.max(F.struct("similarity", (-F.col("child_id")).alias("c"))).alias("m"))
    return best.select("parent_id", (-F.col("m.c")).alias("child_id"), F.col("m.similarity").alias("similarity"))


def rollup(edges: DataFrame, hierarchy: DataFrame, layer: int = 1) -> DataFrame:
    """(head_id, tail_id, relation, weight): weights of edges between children of different parents, summed
    per unordered pair of parents and capped; a child of several parents counts for the smallest."""
    up = links(hierarchy).groupBy("child_id").agg(F.min("parent_id").alias("p"))
    j = edges.select("head_id", "tail_id", "weight").join(up.select(F.col("child_id").alias("head_id"), F.col("p").alias("ph")), "head_id").join(up.select(F.col("child_id").alias("tail_id"), F.col("p").alias("pt")), "tail_id").filter("ph <> pt")
    g = j.groupBy(F.least("ph", "pt").alias("head_id"), F.greatest("ph", "pt").alias("tail_id")).agg(F.round(F.least(F.sum("weight"), F.lit(MAX_WEIGHT)), 6).alias("weight"))
    return g.select("head_id", "tail_id", F.lit(f"__summary_L{layer}__").alias("relation"), "weight")


def ancestors(hierarchy: DataFrame) -> DataFrame:
    """(id, ancestor_id, depth): transitive closure up the tree with the least depth, however deep it is. Cycles end
    where they give no new pair."""
    up = materialize(links(hierarchy).filter("parent_id <> child_id"), "up")
    front = up.select(F.col("child_id").alias("id"), F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("depth"))
    seen = front
    for depth in itertools.count(2):
        step = front.join(up.select(F.col("child_id").alias("ancestor_id"), "parent_id"), "ancestor_id").select("id", F.col("parent_id").alias("ancestor_id")).distinct()
        front = materialize(step.join(seen.select("id", "ancestor_id"), ["id", "ancestor_id"], "left_anti").withColumn("depth", F.lit(depth)), "front")
        if not front.limit(1).collect():
            break
        seen = materialize(seen.unionByName(front), "closure")
    return seen


def build(nodes: DataFrame, pairs: DataFrame, vectors: DataFrame, max_layer: int = 4, node_cap: int = 8, kernel: Kernel = DIGEST, resolution: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(entities, hierarchy) of the summary layers over nodes (id, canonical) and weighted pairs (a, b, weight).

    While a layer has more than ``node_cap`` nodes, its communities become the parents of the next; it stops
    when a layer is not smaller than the one below. A parent's id is negative: minus (layer * 2^40 + smallest
    member's id), its name tells layer, centroid child and first child.
    """
    spark = nodes.sparkSession
    parents = spark.createDataFrame([], "id long, canonical string, description string, layer int")
    tree = spark.createDataFrame([], "parent_id long, child_id long, layer int")
    level, arcs, hv = nodes.select("id", "canonical"), pairs, vectors
    n = level.count()
    for layer in range(1, max_layer + 1):
        if n <= node_cap:
            break
        c = materialize(communities(arcs, level, resolution=resolution).select(F.col("id").alias("child_id"), F.abs("community").alias("m")), "communities")
        c = c.withColumn("parent_id", -(F.lit(layer * 2**40) + F.pmod("m", F.lit(2**40))))
        m = c.select("parent_id").distinct().count()
        if m >= n:
            break
        hier = materialize(c.select("parent_id", "child_id", F.lit(layer).alias("layer")), "hierarchy")
        bundle = materialize(V.assembled(parent_bundles(hier, hv, kernel), ["parent_id"]).select(F.col("parent_id").alias("id"), F.col("hv").cast("array<double>").alias("hv")), "bundles")
        rep = centroid_children(hier, hv, kernel).select("parent_id", F.col("child_id").alias("rep"))
        sizes = hier.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n"), F.min("child_id").alias("first"))
        name = lambda k: level.select(F.col("id").alias(k), F.col("canonical").alias(f"{k}_name"))
        named = sizes.join(rep, "parent_id", "left").join(name("rep"), "rep", "left").join(name("first"), "first")
        up = materialize(named.select(F.col("parent_id").alias("id"), F.concat_ws("::", F.lit(f"L{layer}"), F.coalesce("rep_name", "first_name"), "first_name").alias("canonical"), F.format_string("summary of %d layer-%d nodes", F.col("n"), F.lit(layer - 1)).alias("description"), F.lit(layer).alias("layer")), "parents")
        parents, tree = parents.unionByName(up), tree.unionByName(hier)
        rolled = rollup(arcs.select(F.col("a").alias("head_id"), F.col("b").alias("tail_id"), "weight"), hier, layer)
        arcs = materialize(rolled.select(F.col("head_id").alias("a"), F.col("tail_id").alias("b"), "weight"), "arcs")
        level, hv, n = up.select("id", "canonical"), bundle, m
    return parents, tree


def _stated(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, id): all rows (id) for a stated set of queries, which is held against them in blocks of ids."""
    ids, out = [], None
    for r in queries.select("query_id").distinct().toLocalIterator():
        ids.append(r["query_id"])
        if len(ids) == BLOCK:
            out, ids = _with(out, rows, ids), []
    return _with(out, rows, ids) if ids or out is None else out


def _with(out: DataFrame | None, rows: DataFrame, ids: list[int]) -> DataFrame:
    part = rows.select(F.explode(F.array(*[F.lit(i).cast("long") for i in ids]) if ids else F.array().cast("array<bigint>")).alias("query_id"), "id")
    return part if out is None else out.unionByName(part)


def route(queries: DataFrame, entities: DataFrame, hierarchy: DataFrame, vectors: DataFrame, beam: int = 3, leaf_beam_multiplier: int = 4, kernel: Kernel = DIGEST) -> tuple[DataFrame, DataFrame]:
    """Beam search from the top layer to the leaves for queries (query_id, hv).

    Returns (query_id, layer, id, similarity) of the nodes kept per layer, and (query_id, touched,
    touch_fraction). Without a hierarchy every leaf is a candidate. Nodes without a vector are dropped.
    """
    up = materialize(links(hierarchy), "up")
    sizes = {r["layer"]: r["n"] for r in entities.groupBy("layer").agg(F.count(F.lit(1)).alias("n")).collect()}
    top = max(sizes, default=0)
    layer = entities.filter(F.col("layer") == top).select("id")
    if top == 0:
        kept = _stated(queries, layer).select("query_id", F.lit(0).alias("layer"), "id", F.lit(None).cast("double").alias("similarity"))
        return kept, kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("touched"), F.lit(1.0).alias("touch_fraction"))
    q = materialize(queries, "queries")
    found = _stated(q, layer)  # every query starts from all of the top layer
    all_kept, touched = None, None
    for k in range(top, -1, -1):
        width = beam if k > 0 else beam * leaf_beam_multiplier
        count = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
        touched = count if touched is None else touched.unionByName(count)
        s = found.join(vectors.select("id", "hv"), "id").join(q.select("query_id", F.col("hv").alias("q_hv")), "query_id").select("query_id", "id", F.round(kernel.similarity(F.col("hv"), F.col("q_hv")), 6).alias("similarity"))
        w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
        kept = materialize(s.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= width).select("query_id", F.lit(k).alias("layer"), "id", "similarity"), "kept")
        all_kept = kept if all_kept is None else all_kept.unionByName(kept)
        found = kept.join(up.select(F.col("parent_id").alias("id"), "child_id"), "id").select("query_id", F.col("child_id").alias("id")).distinct()
    n = sizes.get(0, 0)
    total = touched.groupBy("query_id").agg(F.sum("n").alias("touched"))
    return all_kept, total.select("query_id", "touched", F.round(F.lit(1.0) if n == 0 else F.col("touched") / n, 6).alias("touch_fraction"))

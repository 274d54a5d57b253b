"""Subgraph composition: bind the paths of an activated subgraph into one vector, and attribute it.

A path's vector is head * (relation * tail); paths are bundled with integer copy counts. Leave-one-out
attributions are read off the total (total minus own contribution), with the deadband recomputed for the
copies that remain. Relation symbols are seeded by the relation's name, so they do not depend on order.
Quarantined edges take no part. The kernel says how vectors are bound, added up and compared; everything is keyed
by query_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemic.functions import vectors as V
from mnemic.functions.kernels import Digest, Kernel
from mnemic.session import materialize

DIGEST = Digest()
#: Paths of an attribution.
TOP_PATHS = 8


def paths(edges: DataFrame, active: DataFrame, vectors: DataFrame, kernel: Kernel = DIGEST) -> DataFrame:
    """(query_id, edge_id, u, relation, v, w, copies, hv) from edges (id, head_id, tail_id, relation, weight),
    active (query_id, id, activation) and vectors (id, hv); edges with both ends active and known. Edges that
    have a query_id themselves take part in that query only."""
    a = active.select("query_id", F.col("id").alias("u"), F.col("activation").alias("au"))
    b = active.select("query_id", F.col("id").alias("v"), F.col("activation").alias("av"))
    own = ["query_id"] if "query_id" in edges.columns else []
    e = edges.select(*own, F.col("id").alias("edge_id"), F.col("head_id").alias("u"), "relation", F.col("tail_id").alias("v"), "weight")
    j = e.join(a, [*own, "u"]).join(b, ["query_id", "v"])
    hv = lambda k: vectors.select(F.col("id").alias(k), F.col("hv").alias(f"h{k}"))
    j = j.join(hv("u"), "u").join(hv("v"), "v")
    w = F.greatest(F.lit(0.0), F.col("au") * F.col("av")) * F.coalesce("weight", F.lit(0.0))
    symbols = j.select("relation").distinct().select("relation", kernel.symbol(F.concat(F.lit("relation:"), "relation")).alias("hr"))
    j = j.join(symbols, "relation")
    path = kernel.bind(F.col("hu"), kernel.bind(F.col("hr"), F.col("hv")))
    p = j.select("query_id", "edge_id", "u", "relation", "v", w.alias("w"), path.alias("hv")).filter("hv is not null")
    total = p.groupBy("query_id").agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("n"))
    share = F.when(F.col("total") > 0, F.greatest(F.lit(1), F.rint(F.round(F.col("w") / F.col("total") * F.greatest(F.lit(8), F.col("n")), 9)).cast("int"))).otherwise(1)
    return p.join(total, "query_id").select("query_id", "edge_id", "u", "relation", "v", F.round("w", 9).alias("w"), share.alias("copies"), "hv")


def composed(p: DataFrame, kernel: Kernel = DIGEST, active: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """(query_id, pos, s, n, x) of the weighted bundle of each query's paths. A query of ``active`` without any path
    has the plain bundle of its entities' vectors."""
    whole = kernel.bundle(p, ["query_id"], "copies")
    if active is None or vectors is None:
        return whole
    bare = active.select("query_id", "id").join(p.select("query_id").distinct(), "query_id", "left_anti").join(vectors.select("id", "hv"), "id")
    return whole.unionByName(kernel.bundle(bare, ["query_id"]))


def path_similarity(p: DataFrame, reference: DataFrame, kernel: Kernel = DIGEST) -> DataFrame:
    """(query_id, edge_id, similarity) of every path to its query's reference (query_id, pos, x)."""
    e = V.exploded(p, ["query_id", "edge_id"])
    j = e.join(reference.select("query_id", "pos", F.col("x").alias("c")), ["query_id", "pos"])
    return j.groupBy("query_id", "edge_id").agg(F.round(kernel.alike(F.col("x"), F.col("c")), 6).alias("similarity"))


def top_paths(similar: DataFrame, top: int = TOP_PATHS) -> DataFrame:
    """(query_id, rank, edge_id, similarity): the paths most similar to the reference, ties to the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "edge_id")
    return similar.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("query_id", "rank", "edge_id", "similarity")


def leave_one_out(p: DataFrame, whole: DataFrame, reference: DataFrame | None = None, kernel: Kernel = DIGEST) -> DataFrame:
    """(query_id, level, key, importance): how much similarity to the reference (the composed vector itself if none
    is given) is lost without an entity's paths ('entity') or one path ('edge')."""
    ref = (whole if reference is None else reference).select("query_id", "pos", F.col("x").alias("c"))
    q = materialize(V.exploded(p, ["query_id", "edge_id", "u", "v"], weight="copies"), "path-elements")
    own = q.select("query_id", F.explode(F.array_distinct(F.array("u", "v"))).alias("key"), "pos", (F.col("x") * F.col("n")).alias("s"), "n", F.lit("entity").alias("level")).unionByName(q.select("query_id", F.col("edge_id").alias("key"), "pos", (F.col("x") * F.col("n")).alias("s"), "n", F.lit("edge").alias("level")))
    part = own.groupBy("query_id", "level", "key", "pos").agg(F.sum("s").alias("ps"), F.sum("n").alias("pn"))
    both = whole.select("query_id", "pos", "s", "n", "x").join(ref, ["query_id", "pos"])
    j = part.join(both, ["query_id", "pos"])
    j = j.withColumn("r", F.when(F.col("n") > F.col("pn"), kernel.settle(F.col("s") - F.col("ps"), F.col("n") - F.col("pn"))).otherwise(0))
    rest = j.groupBy("query_id", "level", "key").agg(F.round(kernel.alike(F.col("r"), F.col("c")), 6).alias("without"))
    base = both.groupBy("query_id").agg(kernel.alike(F.col("x"), F.col("c")).alias("base"))
    return rest.join(base, "query_id").select("query_id", "level", "key", F.round(F.col("base") - F.col("without"), 6).alias("importance"))

"""Communities of a weighted undirected graph by distributed local moving, and their modularity.

Contract: a total partition; isolated nodes are communities of their own; weights count; the same input
gives the same result. In each round half of the nodes (by a hash of id and round, so that two sides of a
graph do not swap for ever) move to the neighbouring community with the greatest gain in modularity, ties to
the smaller label, if that beats staying. Weights per (node, community) are summed before any choice, so a
hub's neighbours are never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemic.session import materialize


def communities(pairs: DataFrame, nodes: DataFrame, rounds: int = 200, resolution: float = 1.0, tolerance: float = 0.01) -> DataFrame:
    """(id, community) from (a, b, weight) and (id). Settled when in two rounds, one of each half, at most ``tolerance``
    of the nodes moved; an error if that is not so after ``rounds``."""
    both = materialize(pairs.select("a", "b", "weight").union(pairs.select("b", "a", "weight")), "arcs")
    strength = materialize(both.groupBy(F.col("a").alias("id")).agg(F.sum("weight").alias("k")), "strength")
    twice = strength.agg(F.sum("k")).first()[0] or 1.0
    label = materialize(nodes.select("id", F.col("id").alias("label")).distinct().join(strength, "id", "left").fillna({"k": 0.0}), "labels")
    still, few = 0, tolerance * label.count()
    for i in range(rounds):
        size = label.groupBy("label").agg(F.sum("k").alias("total"))
        votes = both.join(label.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id"), "label").agg(F.sum("weight").alias("w"))
        own = label.select("id", "label", F.lit(0.0).alias("w"))
        options = votes.unionByName(own).groupBy("id", "label").agg(F.sum("w").alias("w"))
        j = options.join(size, "label").join(label.select("id", F.col("label").alias("now"), "k"), "id")
        rest = F.col("total") - F.when(F.col("label") == F.col("now"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("w") - resolution * F.col("k") * rest / twice, 9)
        ranked = j.withColumn("gain", gain).groupBy("id").agg(F.max(F.struct("gain", (F.col("label") == F.col("now")).alias("stay"), (-F.col("label")).alias("l"))).alias("m"))
        turn = F.pmod(F.xxhash64(F.lit(i), "id"), F.lit(2)) == 0
        moved = label.join(ranked, "id", "left").withColumn("best", F.when(turn, -F.col("m.l")))
        new = materialize(moved.select("id", F.coalesce("best", "label").alias("label"), "k", (F.coalesce("best", "label") != F.col("label")).alias("moved")), "labels")
        label = new.select("id", "label", "k")
        still = 0 if new.filter("moved").count() > few else still + 1
        if still == 2:
            break
    else:
        raise RuntimeError(f"communities did not settle in {rounds} rounds")
    # a community is named by its smallest member
    name = label.groupBy("label").agg(F.min("id").alias("community"))
    return label.join(name, "label").select("id", "community")


def modularity(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """One row: modularity of a partition (id, community), and the number of communities."""
    j = pairs.join(label.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(label.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
    inside = j.filter("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("inside"))
    degree = j.select("ca", "weight").union(j.select("cb", "weight")).groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("degree"))
    total = pairs.agg(F.sum("weight")).first()[0] or 1.0
    part = degree.join(inside, "community", "left").fillna({"inside": 0.0})
    q = F.sum(F.col("inside") / total - F.pow(F.col("degree") / (2 * total), F.lit(2)))
    return part.agg(F.round(q, 6).alias("modularity")).withColumn("n_communities", F.lit(label.select("community").distinct().count()))

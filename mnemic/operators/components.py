"""Connected components of an undirected graph given as pairs of ids.

Alternating large-star and small-star steps: every node links to the least node it knows, until nothing
changes. Each step is one shuffle of the arcs; the number of steps grows with the logarithm of the longest
path. A step never gathers a node's neighbours: their minimum is an aggregate that is joined back, and the
node that a step makes a hub only ever receives arcs. Arcs are written to the shared folder after each step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemic.session import materialize


def _star(arcs: DataFrame, large: bool) -> DataFrame:
    """One step on arcs (u, v), u > v, both given once."""
    if large:
        both = arcs.union(arcs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = arcs.groupBy("u").agg(F.min("v").alias("m"))
        moved = arcs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(pairs: DataFrame, max_steps: int = 60) -> DataFrame:
    """(id, component) of every id in ``pairs`` (its first two columns); component is the least id.

    Pairs with a null are ignored; an id that is paired with itself only is its own component.
    """
    a, b = pairs.columns[:2]
    clean = pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).dropna()
    nodes = clean.select(F.col("x").alias("id")).union(clean.select("y")).distinct()
    arcs = materialize(clean.filter("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "arcs")
    print_of = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")]
    before = arcs.agg(*print_of).first()
    for _ in range(max_steps):
        arcs = materialize(_star(_star(arcs, large=True), large=False), "arcs")
        now = arcs.agg(*print_of).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(arcs.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))

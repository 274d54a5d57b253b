"""Structural measures of the leaf graph: clustering, cores, neighbour degrees, betweenness, edge features.

Triangles are counted on edges directed from the end of lower degree to that of higher degree: a hub's
neighbours are then never paired with each other, and the pairs formed are O(edges ^ 1.5) in the worst case.
Self-loops are left out of everything here. Nodes without edges have no row.
"""

from __future__ import annotations

import functools
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemic.session import materialize

#: Arcs or nodes that a task of betweenness looks at together, and bytes of an array that it keeps in memory.
WINDOW, ROOM = 1 << 20, 16 << 20
#: Bits of a row's number that tell its place in its partition; those above tell the partition.
_ROWS = (1 << 33) - 1


def collapsed_max(edges: DataFrame) -> DataFrame:
    """(src, dst, weight): parallel directed edges as one with the greatest weight."""
    return edges.filter("head_id <> tail_id").groupBy(F.col("head_id").alias("src"), F.col("tail_id").alias("dst")).agg(F.max("weight").alias("weight"))


def collapsed_sum(edges: DataFrame) -> DataFrame:
    """(a, b, weight), a < b: parallel undirected edges as one with the sum of weights."""
    return edges.filter("head_id <> tail_id").groupBy(F.least("head_id", "tail_id").alias("a"), F.greatest("head_id", "tail_id").alias("b")).agg(F.round(F.sum("weight"), 6).alias("weight"))


def pairs(edges: DataFrame) -> DataFrame:
    """(a, b), a < b: distinct undirected edges."""
    return edges.filter("head_id <> tail_id").select(F.least("head_id", "tail_id").alias("a"), F.greatest("head_id", "tail_id").alias("b")).distinct()


def counted_pairs(edges: DataFrame) -> DataFrame:
    """(a, b, n), a <= b: undirected edges with the number of rows that each stands for; self-loops too."""
    return edges.groupBy(F.least("head_id", "tail_id").alias("a"), F.greatest("head_id", "tail_id").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def simple_degree(p: DataFrame) -> DataFrame:
    """(id, degree): number of distinct neighbours."""
    return p.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def _directed(p: DataFrame, degree: DataFrame) -> DataFrame:
    """(lo, hi): edges from the end that is smaller in (degree, id)."""
    j = p.join(degree.select(F.col("id").alias("a"), F.col("degree").alias("da")), "a").join(degree.select(F.col("id").alias("b"), F.col("degree").alias("db")), "b")
    up = F.struct("da", "a") < F.struct("db", "b")
    return j.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("hi"))


def triangles(p: DataFrame, degree: DataFrame) -> DataFrame:
    """(x, y, z): every triangle once."""
    d = materialize(_directed(p, degree), "directed")
    one = d.select("lo", F.col("hi").alias("y"))
    two = d.select("lo", F.col("hi").alias("z"))
    wedge = one.join(two, "lo").filter("y < z")  # once, not in both orders
    return wedge.join(d.select(F.least("lo", "hi").alias("y"), F.greatest("lo", "hi").alias("z")), ["y", "z"]).select(F.col("lo").alias("x"), "y", "z")


def clustering(p: DataFrame) -> DataFrame:
    """(id, degree, triangles, clustering) of every node with an edge."""
    deg = simple_degree(p)
    t = triangles(p, deg).select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))
    out = deg.join(t, "id", "left").fillna({"triangles": 0})
    d = F.col("degree")
    return out.select("id", "degree", "triangles", F.round(F.when(d > 1, 2 * F.col("triangles") / (d * (d - 1))).otherwise(0.0), 6).alias("clustering"))


def neighbour_degree(p: DataFrame) -> DataFrame:
    """(id, mean_neighbour_degree)."""
    deg = simple_degree(p)
    both = p.select("a", "b").union(p.select("b", "a"))
    return both.join(deg.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.round(F.avg("degree"), 6).alias("mean_neighbour_degree"))


def cores(p: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(id, core): k-core numbers by the local rule: a node's estimate is the greatest h such that h of its
    neighbours have an estimate of h or more, starting from degrees, until nothing changes. A node's
    neighbours are never gathered: their estimates, cut at the node's own, are counted per value."""
    both = materialize(p.select("a", "b").union(p.select("b", "a")), "arcs")
    core = materialize(simple_degree(p).select("id", F.col("degree").alias("core")), "core")
    total = None
    for _ in range(max_rounds):
        now = core.agg(F.sum("core")).first()[0] or 0
        if now == total:
            return core
        total = now
        j = both.join(core.select(F.col("id").alias("a"), F.col("core").alias("own")), "a").join(core.select(F.col("id").alias("b"), F.col("core").alias("theirs")), "b")
        counts = j.groupBy(F.col("a").alias("id"), F.least("own", "theirs").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        # at most one row per value; values are at most the node's estimate
        at_least = F.sum("n").over(_descending())
        core = materialize(counts.withColumn("up", at_least).groupBy("id").agg(F.max(F.least("v", "up")).alias("core")), "core")
    raise RuntimeError("core numbers did not settle")


def _descending():
    from pyspark.sql.window import Window

    return Window.partitionBy("id").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def edge_features(p: DataFrame) -> DataFrame:
    """(a, b, degree_gap, common, jaccard): |log1p difference of degrees|, common neighbours and their share,
    for existing edges; common neighbours are read off the triangles."""
    deg = simple_degree(p)
    t = triangles(p, deg)
    sides = t.select(F.inline(F.array(*[F.struct(F.least(u, v).alias("a"), F.greatest(u, v).alias("b")) for u, v in (("x", "y"), ("y", "z"), ("x", "z"))])))
    common = sides.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    j = p.join(common, ["a", "b"], "left").fillna({"common": 0}).join(deg.select(F.col("id").alias("a"), F.col("degree").alias("da")), "a").join(deg.select(F.col("id").alias("b"), F.col("degree").alias("db")), "b")
    union = F.col("da") + F.col("db") - F.col("common")
    return j.select("a", "b", F.round(F.abs(F.log1p("da") - F.log1p("db")), 6).alias("degree_gap"), "common", F.round(F.col("common") / union, 6).alias("jaccard"))


def weighted_degree(edges: DataFrame) -> DataFrame:
    """(id, strength): sum of collapsed directed weights at a node, at least 1e-8."""
    c = collapsed_max(edges)
    both = c.select(F.col("src").alias("id"), "weight").union(c.select("dst", "weight"))
    return both.groupBy("id").agg(F.round(F.greatest(F.sum("weight"), F.lit(1e-8)), 6).alias("strength"))


def node_features(edges: DataFrame) -> DataFrame:
    """(id, f0, f1, f2, f3): log1p degree, clustering, core number, log1p mean neighbour degree."""
    p = materialize(pairs(edges), "pairs")
    j = clustering(p).join(cores(p), "id").join(neighbour_degree(p), "id")
    return j.select("id", F.log1p("degree").alias("f0"), F.col("clustering").alias("f1"), F.col("core").cast("double").alias("f2"), F.log1p("mean_neighbour_degree").alias("f3"))


def graph_summary(features: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: means and population deviations of the node features, and the number of distinct directed
    edges per undirected pair of nodes (which can exceed 1)."""
    n_arcs = edges.filter("head_id <> tail_id").select("head_id", "tail_id").distinct().count()
    f = [f"f{i}" for i in range(4)]
    agg = features.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in f], *[F.round(F.stddev_pop(c), 6).alias(f"std_{c}") for c in f])
    return agg.select(*[c for c in agg.columns if c != "n"], F.round(F.when(F.col("n") > 1, F.lit(n_arcs) / (F.col("n") * (F.col("n") - 1) / 2)).otherwise(0.0), 6).alias("density"))


def betweenness(p: DataFrame, pivots: int = 64, seed: int = 0) -> DataFrame:
    """(id, betweenness): unweighted, normalised, from min(n, pivots) sampled sources (exact where that is all).

    A shortest-path pass over the whole graph per pivot is inherent in the measure. Nodes are numbered and arcs
    put in order by Spark; the pivots are dealt to as many tasks as there are cores, and each task reads all arcs
    once, without a shuffle. It keeps them in a file on its own disk that it maps, and, beyond ROOM bytes each, the
    numbers per node too, so memory bounds neither nodes nor arcs, and nothing passes through the driver.
    """
    spark = p.sparkSession
    ranged, before = _in_order(p.select(F.explode(F.array("a", "b")).alias("id")).distinct(), ["id"], "ids")
    n = int(before[-1])
    if not n:
        return spark.createDataFrame([], "id long, betweenness double")
    starts = spark.createDataFrame([(i, int(x)) for i, x in enumerate(before[:-1])], "part int, before long")
    index = materialize(ranged.withColumn("part", _part()).join(F.broadcast(starts), "part").select("id", (F.col("at").bitwiseAND(F.lit(_ROWS)) + F.col("before")).alias("i")), "numbered")
    numbered = p.join(index.select(F.col("id").alias("a"), F.col("i").alias("u")), "a").join(index.select(F.col("id").alias("b"), F.col("i").alias("v")), "b")
    both = numbered.select(F.inline(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))))
    arcs, begin = _in_order(both.select(*[F.col(c).cast("int" if n < 1 << 31 else "long").alias(c) for c in both.columns]), ["src", "dst"], "ordered-arcs")
    k = min(n, pivots)
    rng = np.random.default_rng(seed)
    chosen = np.sort(rng.permutation(n)[:k] if n <= 1 << 24 else rng.choice(n, k, replace=False))
    tasks = min(k, spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = np.int32 if n < 1 << 31 else np.int64
        start, dst, task = _room(n + 1, np.int64), _room(int(begin[-1]), small), None
        for b in batches:
            src, to, at, g = (b.column(c).to_numpy(zero_copy_only=False) for c in ("src", "dst", "at", "task"))
            if len(g):
                task = int(g[0])
                dst[begin[at >> 33] + (at & _ROWS)] = to
                np.add.at(start, src.astype(np.int64) + 1, 1)
        if task is None:
            return
        np.cumsum(start, out=start)
        total, work = _room(n, float), _Pass(n, small)
        for s in chosen[task::tasks]:
            work.add(start, dst, int(s), total)
        for lo in range(0, n, WINDOW):
            at = np.flatnonzero(total[lo : lo + WINDOW])
            yield pa.RecordBatch.from_arrays([pa.array(at + lo, pa.int64()), pa.array(total[lo : lo + WINDOW][at], pa.float64())], ["i", "d"])

    # one partition of all arcs per task; the first part, of no rows, keeps Spark from running single partitions as one
    whole = functools.reduce(DataFrame.union, [arcs.filter("at < 0").withColumn("task", F.lit(-1)), *[arcs.coalesce(1).withColumn("task", F.lit(t)) for t in range(tasks)]])
    part = whole.mapInArrow(run, "i long, d double").groupBy("i").agg(F.sum("d").alias("d"))
    scale = n / k / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return index.join(part, "i", "left").select("id", F.round(F.coalesce("d", F.lit(0.0)) * scale, 6).alias("betweenness"))


def _part() -> Column:
    return F.shiftrightunsigned("at", 33).cast("int")


def _in_order(df: DataFrame, by: list[str], name: str) -> tuple[DataFrame, np.ndarray]:
    """``df`` with ``at``, its row's partition and place in the order of ``by``, as written; and the rows before each
    partition, all rows last."""
    out = materialize(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), name)
    rows = {r["part"]: r["n"] for r in out.groupBy(_part().alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    return out, np.cumsum([0, *(rows.get(i, 0) for i in range(max(rows, default=-1) + 1))])


def _room(n: int, dtype: type) -> np.ndarray:
    """Zeros: in memory up to ROOM bytes, else in a mapped file without a name, which goes when the task ends."""
    if n * np.dtype(dtype).itemsize <= ROOM:
        return np.zeros(n, dtype)
    with tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None) as f:
        return np.memmap(f, dtype, "w+", shape=(n,))


def _leaving(start: np.ndarray, dst: np.ndarray, front: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The arcs that leave the nodes of ``front``, at most WINDOW at a time: nodes, their numbers of arcs (none is 0),
    the arcs' other ends. A node of many arcs comes in several windows."""
    for f in range(0, len(front), WINDOW):
        nodes = np.asarray(front[f : f + WINDOW])
        first = np.asarray(start[nodes])
        ends = np.cumsum(start[nodes + 1] - first)
        shift = first - np.concatenate([[0], ends[:-1]])
        for lo in range(0, int(ends[-1]), WINDOW):
            hi = min(lo + WINDOW, int(ends[-1]))
            x, y = np.searchsorted(ends, [lo, hi - 1], side="right")
            cut = np.concatenate([[lo], ends[x:y], [hi]])
            many = np.diff(cut)
            yield nodes[x : y + 1], many, np.asarray(dst[np.repeat(shift[x : y + 1], many) + np.arange(lo, hi)])


class _Pass:
    """Brandes' dependencies of all nodes on one source, level by level; its arrays serve one source after another."""

    def __init__(self, n: int, small: type) -> None:
        self.dist, self.order, self.slot = (_room(n, small) for _ in range(3))
        self.sigma, self.delta, self.share = (_room(n, float) for _ in range(3))

    def add(self, start: np.ndarray, dst: np.ndarray, s: int, total: np.ndarray) -> None:
        dist, order, slot, sigma, delta, share = self.dist, self.order, self.slot, self.sigma, self.delta, self.share
        dist[:], sigma[:], delta[:], share[:] = -1, 0, 0, 0
        dist[s], sigma[s], order[0] = 0, 1, s
        level = [0, 1]  # where each level begins in order
        while level[-1] > level[-2]:
            depth, end = len(level) - 1, level[-1]
            for nodes, many, v in _leaving(start, dst, order[level[-2] : level[-1]]):
                d = dist[v]
                fresh = v[d < 0]
                at = np.arange(len(fresh))
                slot[fresh] = at
                fresh = fresh[slot[fresh] == at]  # each once
                dist[fresh] = depth
                order[end : end + len(fresh)] = fresh
                end += len(fresh)
                step = (d < 0) | (d == depth)
                np.add.at(sigma, v[step], np.repeat(sigma[nodes], many)[step])
            level.append(end)
        # a node's arcs lead to its own level and the two beside it; of these only the one below has shares yet
        for depth in range(len(level) - 3, 1, -1):
            for lo in range(level[depth], level[depth + 1], WINDOW):
                nodes = order[lo : min(lo + WINDOW, level[depth + 1])]
                share[nodes] = (1 + delta[nodes]) / sigma[nodes]
            for nodes, many, v in _leaving(start, dst, order[level[depth - 1] : level[depth]]):
                delta[nodes] += sigma[nodes] * np.add.reduceat(share[v], np.cumsum(many) - many)
        total += delta

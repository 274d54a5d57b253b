"""Gated propagation of activations over the leaf graph.

A fixed number of layers: each joins node states to the edges, weights the messages by a gate computed from
both ends' features, the edge's features and the graph's summary, sums them per node, and updates the state.
The dense parts run in Arrow batches with numpy; the sums are hash aggregates over one column per dimension,
combined before the shuffle, so a hub costs no more than any other node. Model weights are parameters of a
few thousand numbers, initialised from a seed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from mnemic.operators import roles as R
from mnemic.session import materialize

NODE, EDGE, GRAPH = 4, 3, 9


def _gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x**3)))


class Weights:
    """Seeded weights of the gate, the layers and the head."""

    def __init__(self, hidden: int = 64, layers: int = 2, embed: int = 16, gate_hidden: int = 32, delta: float = 0.5, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        dense = lambda i, o: rng.standard_normal((i, o)) / math.sqrt(i)
        self.hidden, self.layers, self.delta = hidden, layers, delta
        self.node, self.edge, self.graph = dense(NODE, embed), dense(EDGE, embed), dense(GRAPH, embed)
        self.gate1, self.gate2 = dense(4 * embed, gate_hidden), dense(gate_hidden, 1)
        self.enter = dense(NODE + 1, hidden)
        self.message = [dense(hidden, hidden) for _ in range(layers)]
        self.head1, self.head2 = dense(hidden, 32), dense(32, 1)
        self.steps, self.moments = 0, [(np.zeros_like(x), np.zeros_like(x)) for x in (self.head1, self.head2)]

    def supervise(self, h: np.ndarray, initial: np.ndarray, gold: np.ndarray, rate: float = 5e-3, margin: float = 1.0) -> float:
        """One Adam step of the head on a query's bounded set of nodes: pairwise hinge between gold and other nodes
        plus logistic loss. Returns the loss; nothing is done (0) where there is no gold node or nothing else."""
        if not gold.any() or gold.all():
            return 0.0
        z = h @ self.head1
        a = _gelu(z)
        s = (a @ self.head2)[:, 0] + initial
        gap = margin - (s[gold][:, None] - s[~gold][None, :])
        on = gap > 0
        p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        loss = gap[on].sum() / on.size - np.mean(np.log(np.where(gold, p, 1 - p) + 1e-12))
        d = (p - gold) / len(gold)
        d[gold] -= on.sum(1) / on.size
        d[~gold] += on.sum(0) / on.size
        step = 1e-5
        slope = (_gelu(z + step) - _gelu(z - step)) / (2 * step)
        grads = [h.T @ (d[:, None] * self.head2[:, 0][None, :] * slope), a.T @ d[:, None]]
        self.steps += 1
        for i, (g, value) in enumerate(zip(grads, (self.head1, self.head2), strict=True)):
            m, v = self.moments[i]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            value -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)
        return float(loss)

    def gate(self, u: np.ndarray, v: np.ndarray, e: np.ndarray, g: np.ndarray) -> np.ndarray:
        x = np.concatenate([u @ self.node, v @ self.node, e @ self.edge, np.repeat((g @ self.graph)[None, :], len(u), 0)], 1)
        return 1 + self.delta * np.tanh(_gelu(x @ self.gate1) @ self.gate2)[:, 0]


def _dense(matrix: np.ndarray):
    @F.pandas_udf(ArrayType(DoubleType()))
    def apply(h: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(h.to_numpy()) @ matrix))

    return apply


def propagate(edges: DataFrame, activation: DataFrame, weights: Weights | None = None, states: bool = False) -> DataFrame:
    """([query_id,] id, initial, final[, h]): activations ([query_id,] id, activation) after propagation over leaf edges.

    Without query ids, nodes that have no activation start at 0. With them every query is propagated by itself, over
    the nodes that have an activation in it. A graph without edges leaves activations as they are. ``states`` adds
    the last hidden state."""
    keys = [c for c in ("query_id", "id") if c in activation.columns]
    per_query = len(keys) == 2
    w = weights or Weights()
    edges = materialize(edges.select("id", "head_id", "tail_id", "weight"), "edges")
    c = materialize(R.collapsed_max(edges), "collapsed")
    start = activation.groupBy(*keys).agg(F.max("activation").alias("initial"))
    if not c.limit(1).collect():
        return start.select(*keys, "initial", F.col("initial").alias("final"), *([F.array_repeat(F.lit(0.0), w.hidden).alias("h")] if states else []))
    nodes = materialize(R.node_features(edges), "features")
    summary = R.graph_summary(nodes, edges).first()
    g = np.array([summary[k] for k in summary.asDict()], dtype=float)
    strength = R.weighted_degree(edges)
    p = R.pairs(edges)
    ef = R.edge_features(materialize(p, "pairs"))
    f = F.array(*[F.col(f"f{i}") for i in range(NODE)])
    feats = materialize(nodes.select("id", f.alias("f")).join(strength, "id"), "nodes")
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    j = c.withColumn("a", a).withColumn("b", b).join(ef, ["a", "b"])
    j = j.join(feats.select(F.col("id").alias("src"), F.col("f").alias("fu"), F.col("strength").alias("su")), "src").join(feats.select(F.col("id").alias("dst"), F.col("f").alias("fv"), F.col("strength").alias("sv")), "dst")

    @F.pandas_udf(DoubleType())
    def gate(fu: pd.Series, fv: pd.Series, gap: pd.Series, common: pd.Series, jac: pd.Series) -> pd.Series:
        e = np.stack([gap.to_numpy(float), common.to_numpy(float), jac.to_numpy(float)], 1)
        return pd.Series(w.gate(np.stack(fu.to_numpy()), np.stack(fv.to_numpy()), e, g))

    eta = F.col("weight") / F.sqrt(F.col("su") * F.col("sv"))
    arcs = j.select("src", "dst", (eta * gate("fu", "fv", "degree_gap", "common", "jaccard")).alias("m"))
    both = materialize(arcs.union(arcs.select("dst", "src", "m")), "messages")  # both directions share the gate

    @F.pandas_udf(ArrayType(DoubleType()))
    def enter(f: pd.Series, act: pd.Series) -> pd.Series:
        x = np.concatenate([np.stack(f.to_numpy()), act.to_numpy(float)[:, None]], 1)
        return pd.Series(list(np.tanh(x @ w.enter)))

    entered = feats.join(start, "id", "inner" if per_query else "left").fillna({"initial": 0.0})
    state = entered.select(*keys, "initial", enter("f", "initial").alias("h"))
    for layer in range(w.layers):
        state = materialize(state, "state")

        turn = _dense(w.message[layer])

        @F.pandas_udf(ArrayType(DoubleType()))
        def update(h: pd.Series, agg: pd.Series) -> pd.Series:
            x = np.stack(agg.to_numpy())
            y = np.stack(h.to_numpy()) + np.where(x > 0, x, 0.25 * x)
            y = (y - y.mean(1, keepdims=True)) / np.sqrt(y.var(1, keepdims=True) + 1e-5)
            return pd.Series(list(y))

        sent = state.withColumnRenamed("id", "src").select(*keys[:-1], "src", turn("h").alias("x"))
        sums = both.join(sent, "src").withColumnRenamed("dst", "id").groupBy(*keys).agg(*[F.sum(F.col("x")[i] * F.col("m")).alias(f"s{i}") for i in range(w.hidden)])
        got = sums.select(*keys, F.array(*[F.col(f"s{i}") for i in range(w.hidden)]).alias("agg"))
        zero = F.array_repeat(F.lit(0.0), w.hidden)
        state = state.join(got, keys, "left").select(*keys, "initial", update("h", F.coalesce("agg", zero)).alias("h"))

    @F.pandas_udf(DoubleType())
    def head(h: pd.Series) -> pd.Series:
        return pd.Series((_gelu(np.stack(h.to_numpy()) @ w.head1) @ w.head2)[:, 0])

    return state.select(*keys, "initial", F.round(head("h") + F.col("initial"), 6).alias("final"), *(["h"] if states else []))

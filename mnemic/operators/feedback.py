"""Rewards of retrieval against gold documents, and the updates that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Weights of recall, precision and deductive reward; of repetition and format.
ALPHA, BETA, GAMMA, REPETITION, FORMAT = 1.0, 0.5, 1.0, 0.5, 0.1


def rewards(retrieved: DataFrame, gold: DataFrame, supported: DataFrame | None = None, repetition: DataFrame | None = None) -> DataFrame:
    """(query_id, n_retrieved, n_gold, n_hit, recall, precision, deductive, repetition, format, task, total) from
    (query_id, key) sets; queries of either side count. ``supported`` (query_id) has the queries with a gold entity
    active; by default those with a hit. ``repetition`` (query_id, repetition) is the share of repeated edges that a
    query used. The bonus for format is 0: answers have no format here."""
    r = retrieved.select("query_id", "key").dropna().distinct().withColumn("r", F.lit(1))
    g = gold.select("query_id", "key").dropna().distinct().withColumn("g", F.lit(1))
    j = r.join(g, ["query_id", "key"], "full")
    a = j.groupBy("query_id").agg(F.count("r").alias("n_retrieved"), F.count("g").alias("n_gold"), F.count(F.when(F.col("r").isNotNull() & F.col("g").isNotNull(), 1)).alias("n_hit"))
    rec = F.when(F.col("n_gold") > 0, F.col("n_hit") / F.col("n_gold")).otherwise(0.0)
    pre = F.when((F.col("n_gold") > 0) & (F.col("n_retrieved") > 0), F.col("n_hit") / F.col("n_retrieved")).otherwise(0.0)
    if supported is None:
        a = a.withColumn("deductive", (F.col("n_hit") > 0).cast("double"))
    else:
        a = a.join(supported.select("query_id").distinct().withColumn("d", F.lit(1.0)), "query_id", "left").withColumn("deductive", F.coalesce("d", F.lit(0.0))).drop("d")
    a = a.withColumn("recall", rec).withColumn("precision", pre)
    task = (ALPHA * F.col("recall") + BETA * F.col("precision") + GAMMA * F.col("deductive")) / (ALPHA + BETA + GAMMA)
    a = a.join(repetition.select("query_id", "repetition"), "query_id", "left").fillna({"repetition": 0.0}) if repetition is not None else a.withColumn("repetition", F.lit(0.0))
    a = a.withColumn("format", F.lit(0.0))
    total = task - REPETITION * F.col("repetition") + FORMAT * F.col("format")
    return a.select("query_id", "n_retrieved", "n_gold", "n_hit", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"), "deductive", F.round("repetition", 6).alias("repetition"), "format", F.round(task, 6).alias("task"), F.round(total, 6).alias("total"))


def edge_rewards(edges: DataFrame, gold: DataFrame, total: float) -> DataFrame:
    """(id, reward): total for edges with a gold end (id), minus half of it for others."""
    g = gold.select("id").distinct()
    at = edges.select("id", "head_id", "tail_id").join(g.select(F.col("id").alias("head_id"), F.lit(1).alias("h")), "head_id", "left").join(g.select(F.col("id").alias("tail_id"), F.lit(1).alias("t")), "tail_id", "left")
    return at.select("id", F.when(F.col("h").isNotNull() | F.col("t").isNotNull(), F.lit(total)).otherwise(F.lit(-0.5 * total)).alias("reward"))

"""Soft addressing: six channels score every leaf entity for every query, then a tempered softmax.

The queries are a stated set: their plans are broadcast in blocks of MAX_QUERIES. Entities and names are scored in
Arrow batches and combined per (query, entity) by a maximum, so an entity's aliases are never gathered. Entities
without any score need no row: the softmax counts them in closed form, from two aggregates per query.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemic.functions import vectors as V
from mnemic.session import spread

# Weights of the channels and the temperature.
WEIGHTS = {"exact": 3.0, "alias": 2.0, "semantic": 1.5, "type": 1.0, "constraint": 0.75, "entity_link": 1.25}
TEMPERATURE = 0.5
#: Plans in one broadcast block; least word-set Jaccard.
MAX_QUERIES, LEAST = 256, 0.6
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


class _Plan:
    """One query's cues in lower case."""

    def __init__(self, query_id, mentions, cues, hard, target, vector) -> None:
        self.query_id, self.target, self.vector = query_id, target, None if vector is None else np.array(vector)
        self.mentions = list(dict.fromkeys(mentions or []))
        self.words = [frozenset(_words(m)) for m in self.mentions]
        self.cues = [c for c in dict.fromkeys(cues or []) if c]
        self.cue_set = frozenset(self.cues)
        self.first: dict[str, list[str]] = {}
        for c in self.cues:
            self.first.setdefault(c[0], []).append(c)
        self.hard = [h for h in hard or [] if h is not None]

    def exact(self, canon: str, words: frozenset[str]) -> float:
        """1 for an equal mention, else the word-set Jaccard where it is LEAST or more."""
        if canon in self.mentions:
            return 1.0
        best = 0.0
        for m in self.words:
            if m and words:
                best = max(best, len(m & words) / len(m | words))
        return best if best >= LEAST else 0.0

    def alias(self, surface: str) -> float:
        if surface in self.cue_set:
            return 1.0
        return 0.5 if surface and any(c in surface or surface in c for c in self.cues) else 0.0

    def link(self, surface: str) -> float:
        """Share of the longer string that is a common beginning, where it is half or more."""
        best = 0.0
        for c in self.first.get(surface[:1], ()):
            r = len(os.path.commonprefix((surface, c))) / max(len(surface), len(c))
            best = max(best, r if r >= 0.5 else 0.0)
        return best


def _words(text: str) -> list[str]:
    return [w for w in _SPACE.split(text) if w]


def _score(shared, kept: str | None, dense: bool):
    """Scores of rows (id, canon, descr, kind, surface[, vector][, query_id]): entities have canon, names surface only.
    Rows without any score are left out unless ``dense``, where every entity has one."""
    types = [pa.int64(), pa.int64(), *[pa.float64()] * len(WEIGHTS)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: list[_Plan] = shared.value
        of = {p.query_id: p for p in plans}
        for batch in batches:
            rows: list[tuple] = []
            cols = {c: batch.column(c).to_pylist() for c in ("id", "canon", "descr", "kind", "surface") if c in batch.schema.names}
            asked = batch.column(kept).to_pylist() if kept else None
            near = None
            if "vector" in batch.schema.names and any(p.vector is not None for p in plans):
                x = np.array([v if v is not None else [0.0] * len(plans[0].vector) for v in batch.column("vector").to_pylist()])
                q = np.stack([p.vector for p in plans])
                norms = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None, :]
                near = np.maximum(0.0, np.divide(x @ q.T, norms, out=np.zeros_like(norms), where=norms > 0))
            for i, (eid, canon, descr, kind, surface) in enumerate(zip(*cols.values(), strict=True)):
                entity = surface is None
                words = frozenset(_words(canon or "")) if entity else frozenset()
                for k, p in enumerate(plans if asked is None else [of[asked[i]]] if asked[i] in of else []):
                    if entity:
                        if asked is not None and near is not None:
                            k = plans.index(p)
                        hard = any(h in (canon or "") or h in (descr or "") for h in p.hard)
                        s = (p.exact(canon, words) if canon is not None else 0.0, 0.0, float(near[i, k]) if near is not None else 0.0, float(kind == p.target and p.target is not None), float(hard), 0.0)
                    else:
                        s = (0.0, p.alias(surface), 0.0, 0.0, 0.0, p.link(surface))
                    if any(s) or dense and entity:
                        rows.append((p.query_id, eid, *s))
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["query_id", "id", *WEIGHTS])

    return scan


def channels(plans: DataFrame, entities: DataFrame, aliases: DataFrame, semantic: bool = True, candidates: DataFrame | None = None, dense: bool = True) -> DataFrame:
    """(query_id, id, exact, alias, semantic, type, constraint, entity_link).

    With ``candidates`` (query_id, id) only these are scored. ``dense``: entities without any score have a row of
    zeros; otherwise they have none."""
    spark = plans.sparkSession
    lower = lambda c: F.transform(c, lambda x: F.lower(x))
    q = plans.select("query_id", lower(F.col("mentions")), F.concat(lower(F.col("mentions")), "aliases"), lower(F.col("constraints")), "target_type", (V.text_vector("text") if semantic else F.lit(None)).alias("v"))
    leaf = entities.filter("layer = 0").select("id", F.lower("canonical").alias("canon"), F.lower(F.coalesce("description", F.lit(""))).alias("descr"), F.lower(F.coalesce("type", F.lit(""))).alias("kind"))
    if semantic:
        leaf = leaf.withColumn("vector", V.text_vector(F.concat_ws(" ", "canon", "descr")))
    named = aliases.select(F.col("entity_id").alias("id"), F.lower("surface").alias("surface")).join(leaf.select("id"), "id", "left_semi")
    named = leaf.select("id", F.col("canon").alias("surface")).unionByName(named).filter("surface is not null")
    rows = leaf.withColumn("surface", F.lit(None).cast("string")).unionByName(named, allowMissingColumns=True)
    if candidates is not None:
        rows = rows.join(candidates.select("query_id", "id").distinct(), "id")
    schema = "query_id long, id long, " + ", ".join(f"`{c}` double" for c in WEIGHTS)
    out = spark.createDataFrame([], schema)
    for block in _blocks(q):
        shared = spark.sparkContext.broadcast(block)  # at most MAX_QUERIES plans
        out = out.unionByName(spread(rows).mapInArrow(_score(shared, "query_id" if candidates is not None else None, dense), schema) if candidates is None else rows.mapInArrow(_score(shared, "query_id", dense), schema))
    # an entity's own scores and those of its names meet by a maximum, combined before the shuffle
    return out.groupBy("query_id", "id").agg(*[F.max(c).alias(c) for c in WEIGHTS])


def _blocks(q: DataFrame) -> Iterator[list[_Plan]]:
    block: list[_Plan] = []
    for row in q.toLocalIterator():
        block.append(_Plan(*row))
        if len(block) == MAX_QUERIES:
            yield block
            block = []
    if block:
        yield block


def activations(scores: DataFrame, temperature: float = TEMPERATURE, weights: dict[str, float] | None = None, rest: int = 0) -> DataFrame:
    """(query_id, id, score, activation): weighted sum of channels, and its softmax over a query's entities.

    ``scores`` may leave out entities without any score: then ``rest`` is the number of all entities, and those
    that are left out take part in the sum with score 0; their activation is added as ``zero``."""
    if temperature <= 0:
        raise ValueError("the temperature must be positive")
    w = {**WEIGHTS, **(weights or {})}
    total = sum((F.col(c) * w[c] for c in WEIGHTS), F.lit(0.0))
    s = scores.select("query_id", "id", total.alias("score"))
    top = s.groupBy("query_id").agg(F.max("score").alias("m"), F.count(F.lit(1)).alias("n")).select("query_id", F.when(F.col("n") < rest, F.greatest("m", F.lit(0.0))).otherwise(F.col("m")).alias("top"), F.greatest(F.lit(0), F.lit(rest) - F.col("n")).alias("left"))
    e = s.join(F.broadcast(top), "query_id").withColumn("e", F.exp((F.col("score") - F.col("top")) / temperature))  # one row per stated query
    z = e.groupBy("query_id").agg((F.sum("e") + F.first("left") * F.exp(-F.first("top") / temperature)).alias("z"))
    none = [F.round(F.exp(-F.col("top") / temperature) / F.col("z"), 9).alias("zero")] if rest else []
    return e.join(F.broadcast(z), "query_id").select("query_id", "id", F.round("score", 6).alias("score"), F.round(F.col("e") / F.col("z"), 9).alias("activation"), *none)


def top_k(acts: DataFrame, k: int = 8) -> DataFrame:
    """(query_id, rank, id, activation): the k strongest entities of each query, ties to the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("activation"), "id")
    return acts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "activation")


def filled(top: DataFrame, scored: DataFrame, queries: DataFrame, leaves: DataFrame, rest: int, k: int = 8) -> DataFrame:
    """``top`` of a result without zero scores, filled up to k entities per query of ``queries``: those left out are
    ties at the activation of score 0, so the ones with the smallest ids follow. ``scored``: activations
    (query_id, id, zero) of those that have a score, ``leaves``: all entities (id), ``rest`` in number."""
    zero = scored.groupBy("query_id").agg(F.max("zero").alias("zero"))
    have = queries.select("query_id").distinct().join(top.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").join(zero, "query_id", "left").fillna({"n": 0, "zero": round(1 / max(1, rest), 9)}).filter(F.col("n") < k)
    # k entities and as many as may have a score already are enough: fewer than k have one in such a query
    some = [r["id"] for r in leaves.select("id").orderBy("id").limit(2 * k).collect()]
    if not some:
        return top
    spare = have.withColumn("id", F.explode(F.array(*[F.lit(x).cast("long") for x in some]))).join(scored.select("query_id", "id"), ["query_id", "id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("id")
    more = spare.withColumn("r", F.row_number().over(w)).filter(F.col("r") + F.col("n") <= k)
    return top.unionByName(more.select("query_id", (F.col("r") + F.col("n")).cast("int").alias("rank"), "id", F.col("zero").alias("activation")))

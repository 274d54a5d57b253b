"""The feedback loop: read a batch of queries, reward the answers, and let the rewards change memory and model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import numpy as np

from mnemic.engine import Memory
from mnemic.operators import feedback, substrate, writer
from mnemic.session import materialize

EVENT = "step long, query_id long, n_retrieved long, n_gold long, n_hit long, recall double, precision double, deductive double, repetition double, format double, task double, total double"


class FeedbackLoop:
    """Steps over a memory. All queries of a step read the same snapshot; their updates are then folded in order of the
    query's id, so a step of one query is the plain loop."""

    def __init__(self, memory: Memory, rate: float = 5e-3) -> None:
        self.memory, self.rate = memory, rate
        self.history = memory.spark.createDataFrame([], EVENT)
        self.separability: list[DataFrame] = []
        self.losses: list[float] = []
        self.steps = 0

    def step(self, queries: DataFrame, now: float, gold_documents: DataFrame | None = None, gold_entities: DataFrame | None = None, half_life: float | None = None, components: DataFrame | None = None) -> DataFrame:
        """One step over queries (query_id, text) with gold documents (query_id, anchor) and entities (query_id, id):
        forget (with ``half_life``), read, reward, reinforce the edges that were used, train the propagation's
        head. Returns the rewards per query, which are appended to ``history``."""
        m, spark = self.memory, self.memory.spark
        if half_life is not None:
            m.decay(now, half_life)
        docs = gold_documents if gold_documents is not None else spark.createDataFrame([], "query_id long, anchor string")
        ents = gold_entities if gold_entities is not None else spark.createDataFrame([], "query_id long, id long")
        docs, ents = materialize(docs.select("query_id", "anchor").distinct(), "gold"), materialize(ents.select("query_id", "id").distinct(), "gold")
        out = m.read(queries)
        events = materialize(self._rewards(queries, out, docs, ents), "rewards")
        self._reinforce(out["edges"], events, ents, now)
        self.losses.append(self._train(out["activated"], ents))
        if components is not None and m.classes is not None:
            self.separability.append(materialize(m.separability(components), "separability"))
        self.steps += 1
        self.history = materialize(self.history.unionByName(events.withColumn("step", F.lit(self.steps).cast("long")).select(*self.history.columns)), "history")
        return events

    @staticmethod
    def _rewards(queries: DataFrame, out: dict[str, DataFrame], docs: DataFrame, ents: DataFrame) -> DataFrame:
        """Rewards by documents for queries with gold documents, else by entities."""
        active = out["activated"].select("query_id", F.col("id").cast("string").alias("key"))
        by_docs = docs.select("query_id").distinct()
        got = out["documents"].select("query_id", F.col("anchor").alias("key")).join(by_docs, "query_id", "left_semi").unionByName(active.join(by_docs, "query_id", "left_anti"))
        gold = docs.select("query_id", F.col("anchor").alias("key")).unionByName(ents.join(by_docs, "query_id", "left_anti").select("query_id", F.col("id").cast("string").alias("key")))
        supported = out["activated"].join(ents, ["query_id", "id"], "left_semi").select("query_id")
        used = out["edges"].groupBy("query_id").agg((1 - F.count_distinct("head_id", "relation", "tail_id") / F.count(F.lit(1))).alias("repetition"))
        r = feedback.rewards(got, gold, supported, used).join(queries.select("query_id").distinct(), "query_id", "right")
        return r.fillna(0)

    def _reinforce(self, edges: DataFrame, events: DataFrame, ents: DataFrame, now: float) -> None:
        """Edges of the activated subgraphs: the reward where an end is gold, minus half of it elsewhere."""
        m = self.memory
        ends = lambda k: ents.select("query_id", F.col("id").alias(k), F.lit(1).alias(f"g_{k}"))
        j = edges.join(ends("head_id"), ["query_id", "head_id"], "left").join(ends("tail_id"), ["query_id", "tail_id"], "left").join(events.select("query_id", "total"), "query_id")
        hit = F.col("g_head_id").isNotNull() | F.col("g_tail_id").isNotNull()
        r = j.select("id", "query_id", (F.when(hit, 1.0).otherwise(-0.5) * F.col("total")).alias("reward"))
        r = materialize(r.withColumn("delta", F.when(F.col("reward") >= 0, F.col("reward") * writer.GAIN).otherwise(F.col("reward") * writer.LOSS)), "deltas")
        old = m.store["edges"]
        start = old.join(r.select("id").distinct(), "id", "left_semi").select("id", F.lit(-1).cast("long").alias("query_id"), F.col("weight").alias("delta"))
        folded = substrate.clamped_fold(start.unionByName(r.select("id", "query_id", "delta")), "id", ["query_id"], 0.0)
        touched = r.filter("reward >= 0").groupBy("id").agg(F.lit(now).alias("at"))
        new = old.join(folded.select("id", F.col("value").alias("_w")), "id", "left").join(touched, "id", "left")
        new = new.withColumn("weight", F.coalesce("_w", "weight")).withColumn("last_used", F.coalesce("at", "last_used"))
        m.store.put("edges", materialize(new.select(*old.columns), "edges"))

    def _train(self, activated: DataFrame, ents: DataFrame) -> float:
        """One step of the propagation's head per query with gold entities, on its activated and gold nodes."""
        wanted = activated.select("query_id", "id").unionByName(ents.select("query_id", "id")).distinct().join(ents.select("query_id").distinct(), "query_id", "left_semi")
        rows = self.memory.states.join(wanted, ["query_id", "id"]).join(ents.withColumn("gold", F.lit(True)), ["query_id", "id"], "left").orderBy("query_id", "id")
        loss, nodes, now = 0.0, [], None

        def learn() -> float:
            h = np.array([r["h"] for r in nodes])
            return self.memory.propagation.supervise(h, np.array([r["initial"] for r in nodes]), np.array([bool(r["gold"]) for r in nodes]), self.rate)

        for r in rows.toLocalIterator():  # a query's top entities and its gold ones
            if now is not None and r["query_id"] != now:
                loss += learn()
                nodes = []
            now = r["query_id"]
            nodes.append(r)
        return loss + (learn() if nodes else 0.0)

"""Beliefs: provenance-ranked assertions with recall, abstention, revision, corroboration, consolidation.

An assertion log is an edge table in order of ``id``; a belief is a distinct (head, relation, tail). Unknown
and null source types have precedence 1 and default confidence 0.5; a confidence that is null, NaN or
outside [0, 1] takes the default of its source type. Ties end at the smallest tail id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemic.operators.hotkeys import canonical_relation
from mnemic.schemas import CONFIDENCE, DEMOTED_CONFIDENCE, HYSTERESIS, MAX_WEIGHT, PRECEDENCE, RETRIEVAL_FLOOR, UNKNOWN_CONFIDENCE, UNKNOWN_PRECEDENCE


def _mapped(values: dict, key: Column, default: float) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def source_kind(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)), F.lit(""))


def precedence(kind: Column) -> Column:
    return _mapped(PRECEDENCE, kind, UNKNOWN_PRECEDENCE)


def default_confidence(kind: Column) -> Column:
    return _mapped(CONFIDENCE, kind, UNKNOWN_CONFIDENCE)


def assertions(edges: DataFrame) -> DataFrame:
    """Edges as an assertion log (id, head_id, relation, tail_id, kind, confidence, provenance_class, charge)."""
    kind = source_kind(F.col("source_type"))
    c = F.col("confidence")
    return edges.select("id", "head_id", canonical_relation(F.col("relation")).alias("relation"), "tail_id", kind.alias("kind"), F.when((c >= 0) & (c <= 1), c + F.lit(0.0)).otherwise(default_confidence(kind)).alias("confidence"), F.coalesce("provenance_class", F.lit("real")).alias("provenance_class"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("charge", F.lit(0.0)))).alias("charge")).dropna(subset=["head_id", "relation", "tail_id"])


def asserted(log: DataFrame) -> DataFrame:
    """Beliefs after all assertions: weight is the capped sum of confidences, everything else is the last
    assertion's; what a model asserts is quarantined."""
    last = F.max_by(F.struct("kind", "confidence", "provenance_class", "charge"), "id").alias("m")
    b = log.groupBy("head_id", "relation", "tail_id").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("w"), last)
    return b.select("id", "head_id", "relation", "tail_id", "m.*", (F.col("m.kind") == "model").alias("quarantined"), F.round(F.when(F.col("n") == 1, F.col("w")).otherwise(F.least("w", F.lit(MAX_WEIGHT))), 6).alias("weight"))


def score() -> Column:
    return precedence(F.col("kind")) + F.col("confidence")


def recalled(beliefs: DataFrame, floor: float = RETRIEVAL_FLOOR, provenance: str | None = "real") -> DataFrame:
    """(head_id, relation, tail_id, score) for every (head, relation) asked of the store: the best active
    belief that clears the floor, null (abstain) where none does."""
    ok = ~F.col("quarantined") & (F.col("confidence") >= floor)
    if provenance is not None:
        ok &= F.col("provenance_class") == provenance
    best = F.max(F.when(ok, F.struct(F.round(score(), 9).alias("s"), (-F.col("tail_id")).alias("t"))))
    return beliefs.groupBy("head_id", "relation").agg(best.alias("b")).select("head_id", "relation", (-F.col("b.t")).alias("tail_id"), F.round("b.s", 6).alias("score"))


def origin(beliefs: DataFrame) -> DataFrame:
    """Beliefs of origin class, quarantined or not, with their charge."""
    return beliefs.filter("provenance_class = 'origin'").select("head_id", "relation", "tail_id", "charge", "quarantined")


def corroborated(beliefs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Beliefs after evidence (head_id, relation, tail_id, kind), one row each: a quarantined belief is
    released with the higher confidence and the stronger source, an active one gains 0.1 up to 1."""
    e = evidence.groupBy("head_id", "relation", "tail_id").agg(F.max_by("kind", F.struct(precedence(F.col("kind")), "kind")).alias("e_kind"))
    j = beliefs.join(e, ["head_id", "relation", "tail_id"], "left")
    hit = F.col("e_kind").isNotNull()
    stronger = _mapped(PRECEDENCE, F.col("e_kind"), 0) > _mapped(PRECEDENCE, F.col("kind"), 0)
    conf = F.when(hit & F.col("quarantined"), F.greatest("confidence", default_confidence(F.col("e_kind")))).when(hit, F.least(F.lit(1.0), F.col("confidence") + 0.1)).otherwise(F.col("confidence"))
    return j.select("id", "head_id", "relation", "tail_id", F.when(hit & F.col("quarantined") & stronger, F.col("e_kind")).otherwise(F.col("kind")).alias("kind"), F.round(conf, 6).alias("confidence"), (F.col("quarantined") & ~hit).alias("quarantined"), hit.alias("changed"))


def contradictions(beliefs: DataFrame) -> DataFrame:
    """(head_id, relation, n_objects, n_beliefs) of groups whose active beliefs differ in their object."""
    return beliefs.filter("not quarantined").groupBy("head_id", "relation").agg(F.count_distinct("tail_id").alias("n_objects"), F.count(F.lit(1)).alias("n_beliefs")).filter("n_objects > 1")


def consolidated(beliefs: DataFrame) -> DataFrame:
    """Beliefs after consolidation: in each contradictory group the best active one stays, active ones with
    another object are demoted. Doing it again changes nothing. Groups are never gathered: the best one is
    an aggregate that is joined back."""
    top = beliefs.filter("not quarantined").groupBy("head_id", "relation").agg(F.max(F.struct(F.round(score(), 9).alias("s"), (-F.col("tail_id")).alias("t"))).alias("b")).select("head_id", "relation", (-F.col("b.t")).alias("keep"))
    j = beliefs.join(top, ["head_id", "relation"], "left")
    demote = ~F.col("quarantined") & (F.col("tail_id") != F.col("keep"))
    return j.select("id", "head_id", "relation", "tail_id", "kind", F.when(demote, F.lit(DEMOTED_CONFIDENCE)).otherwise(F.round("confidence", 6)).alias("confidence"), (F.col("quarantined") | demote).alias("quarantined"), demote.alias("demoted"))


class Revision:
    """The active belief of one (head, relation) under revisions in order; at most one is active."""

    __slots__ = ("tail", "kind", "confidence", "flips", "held", "reinforced")

    def __init__(self, tail: int | None = None, kind: str = "", confidence: float = 0.0, flips: int = 0, held: int = 0, reinforced: int = 0) -> None:
        self.tail, self.kind, self.confidence = tail, kind, confidence
        self.flips, self.held, self.reinforced = flips, held, reinforced

    def apply(self, tail: int, kind: str, confidence: float) -> None:
        if self.tail == tail:
            self.confidence = min(1.0, max(self.confidence, confidence))
            self.kind = kind
            self.reinforced += 1
            return
        if self.tail is None:
            if kind == "model":
                self.held += 1
                return
            self.flips += 1
        else:
            new, old = (PRECEDENCE.get(k, UNKNOWN_PRECEDENCE) for k in (kind, self.kind))
            if not (new > old or new == old and confidence >= self.confidence - HYSTERESIS):
                self.held += 1
                return
            self.flips += 1
        self.tail, self.kind, self.confidence = tail, kind, confidence


REVISED = "head_id long, relation string, tail_id long, kind string, confidence double, flips long, held long, reinforced long"


def _replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (head, relation, id): one state lives at a time."""
    now, state, out = None, Revision(), []
    for df in batches:
        for h, r, t, k, c in zip(df["head_id"], df["relation"], df["tail_id"], df["kind"], df["confidence"], strict=True):
            if (h, r) != now:
                if now is not None:
                    out.append((*now, state))
                now, state = (h, r), Revision()
            state.apply(t, k, c)
        if len(out) > 10_000:
            yield _frame(out)
            out = []
    if now is not None:
        out.append((*now, state))
    yield _frame(out)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = ["head_id", "relation", "tail_id", "kind", "confidence", "flips", "held", "reinforced"]
    df = pd.DataFrame([(h, r, s.tail, s.kind if s.tail is not None else None, s.confidence, s.flips, s.held, s.reinforced) for h, r, s in rows], columns=names)
    return df.astype({"tail_id": "Int64"})


def revised(log: DataFrame) -> DataFrame:
    """Active belief of every (head, relation) after replaying the log as revisions.

    Revision is an ordered fold whose step looks at the state, so a key's rows must be seen in order by one
    task; they are streamed in sorted order with one state in memory, never gathered.
    """
    rows = log.select("head_id", "relation", "id", "tail_id", "kind", "confidence").repartition("head_id", "relation").sortWithinPartitions("head_id", "relation", "id")
    return rows.mapInPandas(_replay, REVISED).withColumn("confidence", F.round("confidence", 6))


class ValueIntegrityError(RuntimeError):
    """A guarded value was to be set by someone else than the operator."""


def set_values(statements: DataFrame, kind: str, confidence: float = 0.99) -> DataFrame:
    """Assertions of guarded values (statement) by the operator; any other source is refused."""
    if kind != "operator":
        raise ValueIntegrityError("values are set by the operator only")
    return statements.select("statement", F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"), F.lit(False).alias("quarantined"))


def guarded(beliefs: DataFrame) -> DataFrame:
    """Beliefs that count as values: active and stated by the operator, whoever wrote them."""
    return beliefs.filter("not quarantined and kind = 'operator'")


def values_block(values: DataFrame) -> str:
    """Text block of all values (statement), one line each; values are few and set by hand."""
    lines = [f"- {r['statement']}" for r in values.select("statement").distinct().orderBy("statement").toLocalIterator()]
    return "\n".join(["Values:", *lines]) if lines else ""

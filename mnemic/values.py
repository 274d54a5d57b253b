"""Values held by an identity: beliefs that only the operator may set, revise, and that count only as the operator's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemic import schemas
from mnemic.engine import Memory
from mnemic.operators import substrate
from mnemic.operators.beliefs import ValueIntegrityError, guarded, source_kind
from mnemic.session import materialize

#: Relation and confidence of values.
RELATION, CONFIDENCE = "__value__", 0.99
#: Statements that ``seed`` sets by default.
DEFAULTS = (
    "Say what is known and where it is from.",
    "Leave a question open rather than guess.",
    "Do no harm to people.",
    "Give most care to those who have least power.",
    "Respect what people decide about themselves.",
    "Work with people as equals.",
    "Keep every change traceable.",
)


class CharacterValues:
    """The values of one identity in a memory's store."""

    def __init__(self, memory: Memory, identity: str = "self") -> None:
        self.memory, self.identity = memory, identity

    @staticmethod
    def _guard(kind: str) -> None:
        if kind != "operator":
            raise ValueIntegrityError(f"values are set by the operator only, not by {kind}")

    def set(self, statements: list[str], now: float, kind: str = "operator") -> None:
        """Hold these statements as values; setting one again changes nothing but its time."""
        self._guard(kind)
        rows = [(self.identity, RELATION, s, kind, CONFIDENCE) for s in dict.fromkeys(statements)]
        if rows:
            self.memory.assert_beliefs(self.memory.spark.createDataFrame(rows, "head string, relation string, tail string, kind string, confidence double"), now)

    def revise(self, old: str, new: str, now: float, kind: str = "operator") -> None:
        """Hold a new statement in place of an old one, which is demoted and kept; its revision time stays."""
        self._guard(kind)
        s = self.memory.store
        gone = self._active().filter(substrate.ascii_fold(F.col("statement")) == substrate.ascii_fold(F.lit(old))).select("id", F.lit(schemas.DEMOTED_CONFIDENCE).alias("confidence"), F.lit(True).alias("quarantined"))
        s.put("edges", materialize(substrate.patch(s["edges"], gone), "edges"))
        self.set([new], now, kind)

    def seed(self, now: float, statements: tuple[str, ...] = DEFAULTS) -> None:
        self.set(list(statements), now)

    def _active(self) -> DataFrame:
        """(id, statement): active values, each as its entity is called; those that anyone else wrote do not count."""
        s = self.memory.store
        me = s["entities"].filter(substrate.ascii_fold(F.col("canonical")) == substrate.ascii_fold(F.lit(self.identity))).select(F.col("id").alias("head_id"))
        held = s["edges"].filter(F.col("relation") == RELATION).join(me, "head_id", "left_semi")
        held = guarded(held.withColumn("kind", source_kind(F.col("source_type"))))
        return held.join(s["entities"].select(F.col("id").alias("tail_id"), F.col("canonical").alias("statement")), "tail_id").select("id", "statement")

    def values(self) -> DataFrame:
        """(statement) of all active values."""
        return self._active().select("statement").distinct()

    def relevant(self, action: str) -> DataFrame:
        """The values that bear on an action: all of them, so that none is out of sight."""
        return self.values()

    def block(self) -> str:
        """All values as text, one line each; '' where there are none."""
        lines = [f"- {r['statement']}" for r in self.values().orderBy("statement").toLocalIterator()]
        return "\n".join(["[held values, set by the operator]", *lines]) if lines else ""

"""Memory across sessions: a store that is opened and closed, encrypted at rest, recalled from and consolidated into."""

from __future__ import annotations

import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from mnemic.engine import Memory
from mnemic.sources import crypto

#: Variable that names the default store.
PATH_VARIABLE = "MNEMIC_STORE"


class MemoryStore:
    """A memory by path. Opening reads the last version (decrypting what is secret as it is read; nothing is written in
    the clear), closing commits a new one."""

    def __init__(self, spark: SparkSession, path: str | None = None, kernel: str = "real", dim: int = 1024, top_k: int = 8, beam: int = 6, encrypted: bool = True, key_path: str | None = None) -> None:
        named = path or os.environ.get(PATH_VARIABLE)
        if not named:
            raise ValueError(f"a store needs a path, or {PATH_VARIABLE}")
        self.spark, self.path, self.encrypted = spark, named, encrypted
        self.key_path = key_path or os.path.join(os.path.dirname(os.path.abspath(os.path.expanduser(named))), "key")
        self.options = {"kernel": kernel, "dim": dim, "top_k": top_k, "beam": beam, "routed": True}
        self._memory: Memory | None = None

    def open(self) -> Memory:
        if self._memory is None:
            key = crypto.get_or_create_key(os.path.expanduser(self.key_path)) if self.encrypted else None
            self._memory = Memory(self.spark, self.path, key=key, **self.options)
        return self._memory

    def close(self) -> None:
        """Commit and forget; closing a closed store does nothing."""
        if self._memory is not None:
            self._memory.store.commit()
            self._memory.close()
            self._memory = None

    def __enter__(self) -> MemoryStore:
        self.open()
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def rebuild_hierarchy(self, **options) -> int:
        return self.open().build_hierarchy(**options)

    def decay(self, now: float, half_life: float, floor: float = 0.0) -> None:
        self.open().decay(now, half_life, floor)

    def n_memories(self) -> int:
        return self.open().store["entities"].count()

    def recall(self, cue: str, max_items: int = 8, rebuild: bool = True) -> str:
        """At most ``max_items`` lines about a cue; the hierarchy is built first if there is none."""
        m = self.open()
        if self.n_memories() == 0:
            return ""
        if rebuild and not m.store["entities"].filter("layer > 0").limit(1).collect():
            m.build_hierarchy()
        return m.recall(cue, max_items)

    def consolidate(self, text: str, anchor: str | None = None, now: float | None = None, rebuild: bool = True) -> int:
        """Take in a session's text under its anchor (once), and rebuild the hierarchy; returns the number of triples."""
        at = time.time() if now is None else now
        m = self.open()
        n = m.ingest(self.spark.createDataFrame([(anchor or f"session-{int(at)}", text)], "anchor string, text string"), at)
        if rebuild and self.n_memories() > 0:
            m.build_hierarchy()
        return n

"""python -m mnemic.cli STORE ingest FILE... | read TEXT | status | shell

In the shell a line is a question, or a command: /ingest TEXT, /feedback QUERY | ANCHOR, ... | ENTITY, ..., /decay
HALF_LIFE, /build, /values, /status, /quit.
"""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Iterable

from pyspark.sql import SparkSession

from mnemic.engine import Memory
from mnemic.loop import FeedbackLoop
from mnemic.sources.store import text_files, text_value
from mnemic.values import CharacterValues


def feedback_arguments(rest: str) -> tuple[str, list[str], list[str]] | None:
    """Query, gold anchors and gold entity names of 'QUERY | a, b | x, y'; None without a query or any gold."""
    parts = [p.strip() for p in rest.split("|")]
    lists = [[x for x in (y.strip() for y in p.split(",")) if x] for p in parts[1:3]]
    anchors, entities = (lists + [[], []])[:2]
    return (parts[0], anchors, entities) if parts[0] and (anchors or entities) else None


def shell(m: Memory, lines: Iterable[str], write=print) -> None:
    """Run commands, one a line, until the end or /quit."""
    loop = FeedbackLoop(m)
    for line in lines:
        command, _, rest = line.strip().partition(" ")
        if command == "/quit":
            return
        if command == "/ingest" and rest:
            write(f"{m.ingest(text_value(m.spark, rest, f'note-{time.time_ns()}'), time.time())} triples")
        elif command == "/feedback":
            asked = feedback_arguments(rest)
            if asked is None:
                write("usage: /feedback QUERY | ANCHOR, ... | ENTITY, ...")
                continue
            query, anchors, names = asked
            gold = m.spark.createDataFrame([(n,) for n in names], "surface string")
            from mnemic.operators.substrate import resolve

            ids = [(1, r["entity_id"]) for r in resolve(gold, m.store["entities"], m.store["aliases"]).collect() if r["entity_id"] is not None]
            docs = m.spark.createDataFrame([(1, a) for a in anchors], "query_id long, anchor string")
            r = loop.step(m.spark.createDataFrame([(1, query)], "query_id long, text string"), time.time(), docs, m.spark.createDataFrame(ids, "query_id long, id long")).first()
            write(f"recall {r['recall']}, precision {r['precision']}, reward {r['total']}")
        elif command == "/decay":
            try:
                m.decay(time.time(), float(rest))
                write("decayed")
            except ValueError:
                write("usage: /decay HALF_LIFE")
        elif command == "/build":
            write(f"{m.build_hierarchy()} summary nodes")
        elif command == "/values":
            write(CharacterValues(m).block() or "no values")
        elif command == "/status":
            write(str(m.summary()))
        elif command.startswith("/"):
            write("unknown command")
        elif command:
            write(m.recall(line.strip()) or "nothing is known")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("store")
    p.add_argument("command", choices=("ingest", "read", "status", "shell"))
    p.add_argument("values", nargs="*")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("mnemic").getOrCreate()
    m = Memory(spark, a.store)
    if a.command == "ingest":
        n = sum(m.ingest(text_files(spark, f), time.time()) for f in a.values)
        m.store.commit()
        print(f"{n} triples, version {m.store.version}")
    elif a.command == "read":
        print(m.recall(" ".join(a.values)))
    elif a.command == "shell":
        shell(m, sys.stdin)
        m.store.commit()
    else:
        print(m.summary())


if __name__ == "__main__":
    main()

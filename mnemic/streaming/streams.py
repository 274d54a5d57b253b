"""Structured Streaming forms: event windows with watermarks, edge reinforcement, belief revision."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from mnemic.operators.beliefs import Revision
from mnemic.session import shared_dir


def table_stream(spark: SparkSession, sf_dir: str, table: str, max_files: int = 1000) -> DataFrame:
    """A table's files as a stream."""
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if os.path.isfile(path):
        return reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)
    return reader.parquet(path)


def with_event_time(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)


def windows(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total) per tumbling or sliding window of ``at``; works on batches and streams."""
    w = F.window("at", size, slide) if slide else F.window("at", size)
    g = events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.unix_timestamp("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, n) of sessions of events no further apart than the gap."""
    g = events.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.unix_timestamp("w.start").alias("start"), "n")


def drain(stream: DataFrame, mode: str = "append", name: str = "stream") -> DataFrame:
    """Run a stream over all that is there and return what it wrote. Complete and update mode keep the last
    batch's result per run; progress and results are in the shared folder."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/mnemic/{name}-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()
    else:

        def keep(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id:06d}")

        q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    schema = stream.schema
    if mode == "append":
        return spark.read.schema(schema).parquet(f"{root}/out")
    out = spark.read.schema(StructType([*schema.fields, StructField("batch", IntegerType())])).parquet(f"{root}/out")
    last = out.agg(F.max("batch")).first()[0]
    return out.filter(F.col("batch") == last).drop("batch") if mode == "complete" else out


def reinforcement(edges: DataFrame, relation) -> DataFrame:
    """Running (head_id, tail_id, relation, n, total): weights are capped when they are read."""
    return edges.groupBy("head_id", "tail_id", relation.alias("relation")).agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("total"))


STATE = "tail long, kind string, confidence double, flips long, held long, reinforced long"
OUTPUT = "head_id long, relation string, tail_id long, kind string, confidence double, flips long"


def _revise(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    s = Revision()
    if state.exists:
        tail, kind, conf, flips, held, reinforced = state.get
        s = Revision(None if tail is None or pd.isna(tail) else int(tail), kind or "", conf, flips, held, reinforced)
    rows = pd.concat(list(batches)).sort_values("id")
    for t, k, c in zip(rows["tail_id"], rows["kind"], rows["confidence"], strict=True):
        s.apply(int(t), k, float(c))
    state.update((s.tail, s.kind, float(s.confidence), s.flips, s.held, s.reinforced))
    yield pd.DataFrame({"head_id": [key[0]], "relation": [key[1]], "tail_id": pd.array([s.tail], "Int64"), "kind": [s.kind if s.tail is not None else None], "confidence": [round(s.confidence, 6)], "flips": [s.flips]})


def revision(log: DataFrame) -> DataFrame:
    """Belief revision per (head, relation) as a stateful operator; emits a key's belief whenever it is touched."""
    return log.groupBy("head_id", "relation").applyInPandasWithState(_revise, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)

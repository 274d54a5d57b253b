"""Queries of propagation, sources, encryption and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemic.operators import beliefs as B
from mnemic.operators.hotkeys import canonical_relation
from mnemic.operators.propagate import propagate
from mnemic.plans.graph_queries import leaves
from mnemic.session import read
from mnemic.sources import crypto, store
from mnemic.streaming import streams


def gnn_propagate(spark: SparkSession, d: str) -> DataFrame:
    """Propagation from persons, all with activation 1."""
    start = read(spark, d, "entities").filter("layer = 0 and lower(type) in ('person', 'individual')").select("id", F.lit(1.0).alias("activation"))
    return propagate(leaves(spark, d), start)


def encrypted_round_trip(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "text")
    key = "00112233445566778899aabbccddeeff" * 2  # a test key
    both = docs.withColumn("back", crypto.decrypted(crypto.encrypted(F.col("text"), key), key))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("text").eqNullSafe(F.col("back")), 1)).alias("n_equal"))


def synthetic_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Cluster sizes of synthetic entities, as many as there are embeddings."""
    entities, edges = store.synthetic_clusters(spark, read(spark, d, "embeddings").count(), 16, 32)
    n = entities.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_members"), F.round(F.avg(F.size("hv")), 1).alias("dim"))
    e = edges.groupBy(F.pmod("tail_id", F.lit(16)).alias("cluster")).agg(F.count(F.lit(1)).alias("n_edges"))
    return n.join(e, "cluster")


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return streams.windows(read(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp")), "1 hour")


def event_windows_sliding(spark: SparkSession, d: str) -> DataFrame:
    return streams.windows(read(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp")), "2 hours", "1 hour")


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return streams.sessions(read(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp")))


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly windows of the events stream, complete result."""
    return streams.drain(streams.windows(streams.with_event_time(streams.table_stream(spark, d, "events")), "1 hour"), "complete", "windows")


def stream_reinforcement(spark: SparkSession, d: str) -> DataFrame:
    """Edge weights from the edges stream, capped at 10 where an edge was written more than once."""
    run = streams.drain(streams.reinforcement(streams.table_stream(spark, d, "edges"), canonical_relation(F.col("relation"))), "complete", "reinforcement")
    return run.select("head_id", "tail_id", "relation", F.round(F.when(F.col("n") == 1, F.col("total")).otherwise(F.least("total", F.lit(10.0))), 6).alias("weight"))


def stream_revision(spark: SparkSession, d: str) -> DataFrame:
    """Belief revision over the edges stream; the last emission of every key."""
    run = streams.drain(streams.revision(B.assertions(streams.table_stream(spark, d, "edges"))), "update", "revision")
    last = run.groupBy("head_id", "relation").agg(F.max_by(F.struct("tail_id", "kind", "confidence", "flips"), "batch").alias("b"))
    return last.select("head_id", "relation", "b.*")


QUERIES = {f.__name__: f for f in (gnn_propagate, encrypted_round_trip, synthetic_clusters, event_windows, event_windows_sliding, event_sessions, stream_windows, stream_reinforcement, stream_revision)}

_WIN = "select epoch(time_bucket(interval '1 hour', ts))::bigint as start, event_type, value from events"
_G = "select start, event_type, count(*) as n, round(sum(value), 4) as total from w group by 1, 2"

ORACLE = {
    "encrypted_round_trip": "select count(*) as n, count(*) as n_equal from documents",
    "synthetic_clusters": """with i as (select range as id from range((select count(*) from embeddings))), n as (select count(*) as n from i), e as (select case when id + 16 < n then id + 16 else id % 16 end as t, id as h from i, n union all select id, id % 16 from i where id >= 16)
      select id % 16 as cluster, count(*) as n_members, 32.0::double as dim, any_value(k) as n_edges from i join (select t % 16 as c, count(*) as k from e where t <> h group by 1) on c = id % 16 group by 1""",
    "event_windows": f"with w as ({_WIN}) {_G}",
    "event_windows_sliding": f"with v as ({_WIN}), w as (select * from v union all select start - 3600, event_type, value from v) {_G}",
    "event_sessions": """with o as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as fresh from events),
      s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from o) select user_id, floor(epoch(min(ts)))::bigint as start, count(*) as n from s group by user_id, k""",
    "stream_windows": f"with w as ({_WIN}) {_G}",
    "stream_reinforcement": "select head_id, tail_id, translate(lower(trim(relation)), ' -', '__') as relation, round(case when count(*) = 1 then sum(weight) else least(sum(weight), 10) end, 6) as weight from edges group by 1, 2, 3",
}
from mnemic.plans.store_queries import ORACLE as _STORE  # noqa: E402

ORACLE["stream_revision"] = f"select head_id, relation, tail_id, kind, confidence, flips from ({_STORE['belief_revise']})"

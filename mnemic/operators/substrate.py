"""The graph store as DataFrame transforms: scans, lookups, upserts, decay, hierarchy maintenance.

A snapshot is never changed in place: each operation returns the new table. Order is always explicit (``seq``
columns) and time is a parameter. Null keys never match. Self-loops count twice in degrees and make a node
its own neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemic.schemas import MAX_WEIGHT

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_fold(s: Column) -> Column:
    """Lower case of ASCII letters only."""
    return F.translate(s, _UPPER, _LOWER)


def source_anchor(source: Column) -> Column:
    """The anchor that an edge's source names: lower case, nothing from '#' on, no surrounding blanks."""
    return F.trim(F.lower(F.substring_index(source, "#", 1)))


# --- scans and lookups ----------------------------------------------------------------------------------


def entities_with_surfaces(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row per entity and distinct surface (null where it has none)."""
    a = aliases.select(F.col("entity_id").alias("id"), "surface").distinct()
    return entities.select("id", "canonical", "type", "layer").join(a, "id", "left")


def resolve(surfaces: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(surface, entity_id, via) of each distinct surface: a canonical name that is equal but for ASCII case
    comes first (smallest id), then the first alias row; null where neither exists."""
    names = entities.select(ascii_fold(F.col("canonical")).alias("k"), F.struct(F.lit(0).alias("p"), F.col("id").alias("o"), F.col("id").alias("e")).alias("hit"))
    other = aliases.select(ascii_fold(F.col("surface")).alias("k"), F.struct(F.lit(1).alias("p"), F.col("id").alias("o"), F.col("entity_id").alias("e")).alias("hit"))
    best = names.unionByName(other).filter("k is not null").groupBy("k").agg(F.min("hit").alias("hit"))
    asked = surfaces.select("surface").distinct().withColumn("k", ascii_fold(F.col("surface")))
    return asked.join(best, "k", "left").select("surface", F.col("hit.e").alias("entity_id"), F.when(F.col("hit.p") == 0, "canonical").when(F.col("hit.p") == 1, "alias").alias("via"))


def incidence(edges: DataFrame) -> DataFrame:
    """(id, edge_id) of both ends of every edge."""
    return edges.select(F.col("id").alias("edge_id"), F.explode(F.array("head_id", "tail_id")).alias("id")).filter("id is not null")


def degree(edges: DataFrame) -> DataFrame:
    return incidence(edges).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def neighbours(edges: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """(id, neighbour), distinct, in both directions; only neighbours in ``leaves`` (id) if given."""
    ways = F.array(F.struct(F.col("head_id").alias("id"), F.col("tail_id").alias("neighbour")), F.struct(F.col("tail_id").alias("id"), F.col("head_id").alias("neighbour")))
    both = edges.select("head_id", "tail_id").dropna().select(F.inline(ways)).distinct()
    return both if leaves is None else both.join(leaves.select(F.col("id").alias("neighbour")), "neighbour", "left_semi").select("id", "neighbour")


def within(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids`` (id)."""
    i = ids.select("id")
    return edges.join(i.withColumnRenamed("id", "head_id"), "head_id", "left_semi").join(i.withColumnRenamed("id", "tail_id"), "tail_id", "left_semi")


def leaf_graph(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges that are not quarantined between entities of layer 0; parallel edges are kept."""
    return within(edges.filter(~F.coalesce("quarantined", F.lit(False))), entities.filter("layer = 0"))


def documents_for(ids: DataFrame, edges: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, anchor) of the distinct documents that edges at one of the ids name as source."""
    anchor = F.trim(F.lower(F.substring_index("source", "#", 1))).alias("anchor")
    ends = edges.filter(F.trim("source") != "").select(F.explode(F.array("head_id", "tail_id")).alias("id"), anchor)
    at = ends.join(ids.select("id"), "id", "left_semi").select("anchor").distinct()
    return documents.select("doc_id", "anchor").join(at, "anchor", "left_semi").select("doc_id", "anchor")


# --- upserts ---------------------------------------------------------------------------------------------


def upsert_entities(log: DataFrame) -> DataFrame:
    """State after a log (seq, canonical, type, description): keyed by exact canonical; the last type and
    the last description that is not empty win; the id is the first seq."""
    d = F.when(F.col("description") != "", F.col("description"))
    return log.filter("canonical is not null").groupBy("canonical").agg(F.min("seq").alias("id"), F.max_by("type", "seq").alias("type"), F.max_by(d, F.when(d.isNotNull(), F.col("seq"))).alias("description"), F.count(F.lit(1)).alias("n_upserts"))


def upsert_edges(log: DataFrame, relation: Column) -> DataFrame:
    """State after a log of edges: keyed by (head, tail, relation); weights add up to MAX_WEIGHT at most (a
    single insert is taken as it is), source and creation stay those of the first row."""
    k = log.select("id", "head_id", "tail_id", relation.alias("relation"), "weight", "source", "created_at").dropna(subset=["head_id", "tail_id", "relation"])
    w = F.coalesce(F.sum("weight"), F.lit(0.0))
    agg = k.groupBy("head_id", "tail_id", "relation").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), w.alias("w"), F.min_by("source", "id").alias("source"), F.min_by("created_at", "id").alias("created_at"))
    return agg.select("id", "head_id", "tail_id", "relation", F.round(F.when(F.col("n") == 1, F.col("w")).otherwise(F.least("w", F.lit(MAX_WEIGHT))), 6).alias("weight"), "source", "created_at", F.col("n").alias("n_upserts"))


def upsert_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """(anchor, doc_id, is_new): documents by anchor; what is there stays, of new ones the first by
    (created_at, doc_id) wins."""
    o = old.filter("anchor is not null").groupBy("anchor").agg(F.min("doc_id").alias("doc_id")).withColumn("is_new", F.lit(False))
    first = new.filter("anchor is not null").groupBy("anchor").agg(F.min_by("doc_id", F.struct("created_at", "doc_id")).alias("doc_id"))
    return o.unionByName(first.join(o.select("anchor"), "anchor", "left_anti").withColumn("is_new", F.lit(True)))


def upsert_hierarchy(rows: DataFrame) -> DataFrame:
    """(id, parent_id, child_id, layer): insert-if-absent by (parent, child); the first row stays."""
    return rows.dropna(subset=["parent_id", "child_id"]).groupBy("parent_id", "child_id").agg(F.min("id").alias("id"), F.min_by("layer", "id").alias("layer")).select("id", "parent_id", "child_id", "layer")


def ensure_entities(surfaces: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(canonical, n_surfaces): entities to be created for surfaces that resolve to none, one per spelling
    without case."""
    none = resolve(surfaces, entities, aliases).filter("entity_id is null")
    return none.groupBy(ascii_fold(F.col("surface")).alias("k")).agg(F.min("surface").alias("canonical"), F.count(F.lit(1)).alias("n_surfaces")).select("canonical", "n_surfaces")


def missing_aliases(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entity_id, surface): canonical names that are not among the aliases of their entity."""
    own = entities.filter("canonical is not null").select(F.col("id").alias("entity_id"), F.col("canonical").alias("surface"))
    return own.join(aliases.select("entity_id", "surface"), ["entity_id", "surface"], "left_anti")


def patch(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Edges with the values of ``changes`` (id, any belief columns) where these are not null; charge is
    clamped to [0, 1]."""
    names = [c for c in changes.columns if c != "id"]
    joined = edges.join(changes.select("id", *[F.col(c).alias(f"new_{c}") for c in names]), "id", "left")
    new = {c: F.coalesce(F.col(f"new_{c}"), F.col(c)) for c in names}
    if "charge" in new:
        new["charge"] = F.greatest(F.lit(0.0), F.least(F.lit(1.0), new["charge"]))
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in edges.columns])


# --- decay and reinforcement -----------------------------------------------------------------------------


def decayed(weight: Column, last_used: Column, created_at: Column, now: float, half_life: float, floor: float = 0.0) -> Column:
    """Weight after forgetting since the last use (else creation), within [floor, MAX_WEIGHT]."""
    if half_life <= 0:
        return weight
    elapsed = F.greatest(F.lit(0.0), F.lit(now) - F.coalesce(last_used, created_at))
    return F.greatest(F.lit(floor), F.least(weight * F.pow(F.lit(0.5), elapsed / half_life), F.lit(MAX_WEIGHT)))


def touched(edges: DataFrame, touches: DataFrame) -> DataFrame:
    """(id, last_used) after touches (id, at): the latest touch of an edge, else what it had."""
    latest = touches.filter("at is not null").groupBy("id").agg(F.max("at").alias("at"))
    return edges.select("id", "last_used").join(latest, "id", "left").select("id", F.coalesce("at", "last_used").alias("last_used"))


def clamped_fold(deltas: DataFrame, key: str, order: list[str], start: float, low: float = 0.0, high: float = MAX_WEIGHT) -> DataFrame:
    """(key, value, n): start, then each delta added in order and clamped to [low, high] every time.

    The fold is not a sum, but it is a composition of clamped shifts x -> clamp(x + d, lo, hi), and such maps
    compose to maps of the same form. Rows are range-partitioned by (key, order), each partition composes
    its run of each key, and the few composed maps of a key are chained in order: a hot key is spread over
    as many partitions as its rows fill. Null deltas count as 0.
    """
    cols = [key, *order]

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps, first = [], 0
        now = None
        for batch in batches:
            for k, d in zip(batch.column(0).to_pylist(), batch.column(len(cols)).to_pylist(), strict=True):
                if maps and now == k:
                    a, lo, hi, n = maps[-1][1:]
                    maps[-1] = (k, a + d, min(max(lo + d, low), high), min(max(hi + d, low), high), n + 1)
                else:
                    maps.append((k, d, low, high, 1))
                    now = k
            first += batch.num_rows
        names = ["k", "a", "lo", "hi", "n"]
        c = list(zip(*maps, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c[0]), kind), *(pa.array(list(x), pa.float64()) for x in c[1:4]), pa.array(list(c[4]), pa.int64())], names=names)

    rows = deltas.select(*cols, F.coalesce(F.col("delta").cast("double"), F.lit(0.0)).alias("delta")).filter(F.col(key).isNotNull())
    type_ = rows.schema[key].dataType
    kind = pa.string() if type_.simpleString() == "string" else pa.int64()
    spread = rows.repartitionByRange(*cols).sortWithinPartitions(*cols)
    maps = spread.mapInArrow(compose, f"k {type_.simpleString()}, a double, lo double, hi double, n long").withColumn("part", F.spark_partition_id())
    # one map per key and partition
    chain = maps.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("part", "a", "lo", "hi"))).alias("m"), F.sum("n").alias("n"))
    value = F.aggregate("m", F.lit(float(start)), lambda x, m: F.greatest(m["lo"], F.least(m["hi"], x + m["a"])))
    return chain.select(F.col("k").alias(key), F.round(value, 6).alias("value"), "n")


def running_count(df: DataFrame, key: str, order: str, width: int = 100_000) -> Column | DataFrame:
    """``df`` with ``tally``: how many rows of the key come before, by the integer column ``order``.

    Counted within blocks of the order column, with the blocks' totals added up: no task holds a key's rows
    of more than one block.
    """
    b = df.withColumn("_block", F.floor(F.col(order) / width))
    total = b.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    offset = total.select(F.col(key).alias("_k"), F.col("_block").alias("_b"), F.coalesce(before, F.lit(0)).alias("_before"))
    local = b.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_block").orderBy(order)) - 1)
    joined = local.join(offset, local[key].eqNullSafe(F.col("_k")) & (local["_block"] == F.col("_b")))
    return joined.withColumn("tally", F.col("_r") + F.col("_before")).drop("_block", "_k", "_b", "_before", "_r")


def base_weight(tally: Column, penalty: float = 0.1) -> Column:
    """Novelty: less the more often the relation was written before, 0.2 at least."""
    return F.greatest(F.lit(0.2), 1 - penalty * F.log1p(tally))


# --- hierarchy -------------------------------------------------------------------------------------------


def cleared(entities: DataFrame, aliases: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, aliases and edges without summary nodes; edges at removed nodes go too."""
    keep = entities.filter("layer = 0")
    gone = entities.filter("layer > 0").select(F.col("id").alias("entity_id"))
    a = aliases.join(gone, "entity_id", "left_anti")
    e = edges.join(gone.withColumnRenamed("entity_id", "head_id"), "head_id", "left_anti").join(gone.withColumnRenamed("entity_id", "tail_id"), "tail_id", "left_anti")
    return keep, a, e

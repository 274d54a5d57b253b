"""References to records that do not exist.

Keys are range-partitioned; the parents of a range are held as sorted arrays; batches of references are
probed against them by binary search; misses are aggregated per table, field and period.

Skew: ranges are cut by counts of the *parents*, so a range holds a bounded number of parents whatever the
references do and however many parents there are. A range that many references fall into (one hot key may hold a
third of all rows) is probed in several slices, each with its own copy of the bounded parent arrays, so no task
holds more than SLICE_ROWS references on average, and copies are at most a fifth as many as references. Parents are
one row per key; the deletions of a key are searched as one sorted array with the latest end so far.

Defined results. A null or empty key is not a reference. A reference row with null ``created_at`` can
only be an orphan because the key is missing; its period is null. NaN times compare as false. Of several
parent rows with one key the earliest counts. Empty tables give empty results (no parents: every
reference is missing). Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemic.session import materialize

#: Parents a range may hold, references a slice should hold, cells that a part of the key space is counted in.
RANGE_ROWS, SLICE_ROWS, CELLS = 50_000, 250_000, 4096
#: Key spaces: integer keys are ranged by value, text keys by their 64-bit hash (the text decides).
ENTITY, DOCUMENT = 0, 1

FIELDS = {0: ("edges", "head_id"), 1: ("edges", "tail_id"), 2: ("edges", "source"), 3: ("aliases", "entity_id")}
REASONS = {0: "missing", 1: "later", 2: "deleted"}


def anchor_of(source: Column) -> Column:
    """The anchor that a ``source`` names: lower case, nothing from '#' on, no surrounding blanks."""
    return F.trim(F.lower(F.substring_index(source, "#", 1)))


def month_of(epoch: Column) -> Column:
    """'YYYY-MM' in UTC of a Unix time, whatever the session's time zone."""
    day = F.floor(F.when(~F.isnan(epoch), epoch) / 86400).cast("int")
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day), "yyyy-MM")


def references(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """All references as (field, row_id, space, k, s, t); one scan per table."""

    def ref(field: int, space: int, k: Column, s: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), F.lit(space).alias("space"), k.alias("k"), s.alias("s"))

    none = F.lit(None).cast("string")
    anchor = anchor_of(F.col("source"))
    e = edges.select(
        F.col("id").alias("row_id"),
        F.col("created_at").alias("t"),
        F.inline(
            F.array(
                ref(0, ENTITY, F.col("head_id"), none),
                ref(1, ENTITY, F.col("tail_id"), none),
                ref(2, DOCUMENT, F.when(anchor != "", F.xxhash64(anchor)), anchor),
            )
        ),
    )
    a = aliases.select(F.col("id").alias("row_id"), F.col("created_at").alias("t"), F.lit(3).alias("field"), F.lit(ENTITY).alias("space"), F.col("entity_id").alias("k"), none.alias("s"))
    return e.unionByName(a).filter("k is not null")


def parents(entities: DataFrame, documents: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Parent rows and deletions as (space, kind, k, s, a, b): kind 0 has a = created_at; kind 1 has
    a = deleted_at, b = restored_at."""
    none_s, none_d = F.lit(None).cast("string"), F.lit(None).cast("double")
    ent = entities.select(F.lit(ENTITY).alias("space"), F.lit(0).alias("kind"), F.col("id").alias("k"), none_s.alias("s"), F.col("created_at").alias("a"), none_d.alias("b"))
    doc = documents.select(F.lit(DOCUMENT).alias("space"), F.lit(0).alias("kind"), F.xxhash64("anchor").alias("k"), F.col("anchor").alias("s"), F.col("created_at").alias("a"), none_d.alias("b")).filter("s is not null")
    tomb = tombstones.filter("table_name in ('entities', 'documents') and deleted_at is not null").select(
        F.when(F.col("table_name") == "entities", ENTITY).otherwise(DOCUMENT).alias("space"),
        F.lit(1).alias("kind"),
        F.when(F.col("table_name") == "entities", F.expr("try_cast(ref_key as bigint)")).otherwise(F.xxhash64("ref_key")).alias("k"),
        F.when(F.col("table_name") == "documents", F.col("ref_key")).alias("s"),
        F.col("deleted_at").alias("a"),
        F.col("restored_at").alias("b"),
    )
    # one row per key and per deletion, combined before the shuffle
    live = ent.unionByName(doc).filter("k is not null").groupBy("space", "kind", "k", "s").agg(F.min(F.coalesce(F.when(~F.isnan("a"), F.col("a")), F.lit(float("-inf")))).alias("a"), F.max("b").alias("b"))
    ends = F.max(F.coalesce("b", F.lit(float("inf")))).alias("b")
    gone = tomb.filter("k is not null").groupBy("space", "kind", "k", "s", "a").agg(ends)
    return live.unionByName(gone)


def _cell(starts: np.ndarray, widths: np.ndarray, ends: np.ndarray):
    """(i, c): the part of the key space that a key is in (-1 for none) and its cell there."""

    @F.pandas_udf("struct<i: int, c: long>")
    def cell(k: pd.Series) -> pd.DataFrame:
        x = k.to_numpy(np.int64)
        i = np.searchsorted(starts, x, "right") - 1
        c = ((x.astype(np.uint64) - starts[i].astype(np.uint64)) // widths[i].astype(np.uint64)).astype(np.int64)
        return pd.DataFrame({"i": np.where((i >= 0) & (x <= ends[i]), i, -1).astype(np.int32), "c": c})

    return cell


def _cuts(keys: DataFrame) -> np.ndarray:
    """First keys of ranges that hold at most RANGE_ROWS distinct keys each (sorted; empty for one range).

    Keys are counted in equal cells of the key space, and cells that hold more are counted in cells of their own, until
    none does. A round sends at most CELLS counts for each range that is too full, of which there are at most one per
    RANGE_ROWS keys; there are at most 64 / log2(CELLS) rounds."""
    low, high, n = keys.agg(F.min("k"), F.max("k"), F.count(F.lit(1))).first()
    if n <= RANGE_ROWS:
        return np.zeros(0, np.int64)
    full, counts = [(low, high)], []
    while full:
        starts = np.array([a for a, _ in full], np.int64)
        widths = np.array([max(1, -(-(b - a + 1) // CELLS)) for a, b in full], np.int64)
        ends = np.array([b for _, b in full], np.int64)
        rows = keys.select(_cell(starts, widths, ends)("k").alias("x")).select("x.*").filter("i >= 0").groupBy("i", "c").agg(F.count(F.lit(1)).alias("n")).collect()
        again = []
        for r in rows:
            a = int(starts[r["i"]]) + r["c"] * int(widths[r["i"]])
            if r["n"] > RANGE_ROWS and widths[r["i"]] > 1:
                again.append((a, min(a + int(widths[r["i"]]) - 1, full[r["i"]][1])))
            else:
                counts.append((a, r["n"]))
        full = sorted(again)
    cuts, held = [], 0
    for a, k in sorted(counts):
        if held and held + k > RANGE_ROWS:
            cuts.append(a)
            held = 0
        held += k
    return np.array(cuts, np.int64)


class _Ranges:
    """Numbers of the ranges of keys, over both key spaces."""

    def __init__(self, cuts: dict[int, np.ndarray]) -> None:
        self.cuts = cuts
        self.offset = {ENTITY: 0, DOCUMENT: len(cuts[ENTITY]) + 1}
        self.n = len(cuts[ENTITY]) + len(cuts[DOCUMENT]) + 2

    def of(self, space: np.ndarray, k: np.ndarray) -> np.ndarray:
        out = np.zeros(len(k), np.int32)
        for x in (ENTITY, DOCUMENT):
            mine = space == x
            out[mine] = self.offset[x] + np.searchsorted(self.cuts[x], k[mine], "right")
        return out


def _places(deleted: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Deletions sorted by (key code, time): codes, ranks of the times among ``times``, times, latest end so far."""
    d = deleted.sort_values(["code", "a"], kind="stable")
    code, a = d["code"].to_numpy(np.int64), d["a"].to_numpy(float)
    end = pd.Series(np.where(np.isnan(d["b"].to_numpy(float)), np.inf, d["b"].to_numpy(float))).groupby(code).cummax().to_numpy()
    times = np.unique(a)
    return code, np.searchsorted(times, a), times, end


def _probe(refs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """Binary search of one slice of references in the sorted arrays of its range."""
    t = refs["t"].to_numpy(dtype="float64", na_value=np.nan)
    k = refs["k"].to_numpy(dtype="int64")
    s = refs["s"].to_numpy(dtype=object)
    text = refs["space"].to_numpy() == DOCUMENT
    n = len(refs)
    first = np.full(n, np.inf)  # earliest creation of the parent; inf where there is none
    there, gone = np.zeros(n, bool), np.zeros(n, bool)
    for space in (ENTITY, DOCUMENT):
        rows = np.flatnonzero(text == (space == DOCUMENT))
        part = known[known["space"] == space].copy()
        if not len(rows) or not len(part):
            continue
        part["s"] = part["s"].fillna("")
        keys = part[["k", "s"]].drop_duplicates().sort_values(["k", "s"], kind="stable")
        pk, ps = keys["k"].to_numpy(np.int64), keys["s"].to_numpy(dtype=object)
        part["code"] = part.merge(keys.assign(code=np.arange(len(keys))), on=["k", "s"], how="left")["code"].to_numpy()
        # the code of each reference's key; texts whose hashes are equal stand side by side
        at, code = np.searchsorted(pk, k[rows], "left"), np.full(len(rows), -1)
        open_ = np.arange(len(rows))
        while len(open_):
            open_ = open_[at[open_] < len(pk)]
            open_ = open_[pk[at[open_]] == k[rows[open_]]]
            same = np.ones(len(open_), bool) if space == ENTITY else ps[at[open_]] == s[rows[open_]]
            code[open_[same]] = at[open_[same]]
            open_ = open_[~same]
            at[open_] += 1
        hit = np.flatnonzero(code >= 0)
        rows, code = rows[hit], code[hit]
        made = np.full(len(keys), np.nan)
        alive = part[part["kind"] == 0]
        made[alive["code"].to_numpy(np.int64)] = alive["a"].to_numpy(float)
        exists = np.zeros(len(keys), bool)
        exists[alive["code"].to_numpy(np.int64)] = True
        there[rows], first[rows] = exists[code], np.where(np.isnan(made[code]), -np.inf, made[code])
        deleted = part[part["kind"] == 1]
        if len(deleted):
            dc, rank, times, end = _places(deleted)
            width = len(times) + 1
            # the last deletion of the key that is not after the reference, and the latest end of those up to it
            i = np.searchsorted(dc * width + rank, code * width + np.searchsorted(times, t[rows], "right"), "left") - 1
            ok = (i >= 0) & ~np.isnan(t[rows])
            i = np.where(ok, i, 0)
            gone[rows] = ok & (dc[i] == code) & (end[i] > t[rows])
    why = np.where(~there, 0, np.where(first > t, 1, np.where(gone, 2, -1)))
    out = pd.DataFrame({"field": refs["field"].to_numpy(), "row_id": refs["row_id"].to_numpy(), "t": t, "why": why.astype("int32")})
    return out[why >= 0]


def orphans(edges: DataFrame, aliases: DataFrame, entities: DataFrame, documents: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Orphan references: (table_name, ref_field, row_id, period, reason).

    reason is 'missing' (no such key), 'later' (the parent was created after the reference) or 'deleted'
    (a deletion was in force); where several hold, the first of these.
    """
    known, refs = materialize(parents(entities, documents, tombstones), "parents"), references(edges, aliases)
    ranges = _Ranges({x: _cuts(known.filter((F.col("space") == x) & (F.col("kind") == 0)).select("k")) for x in (ENTITY, DOCUMENT)})
    sc = edges.sparkSession.sparkContext
    shared = sc.broadcast(ranges)  # 8 bytes for every RANGE_ROWS parents

    @F.pandas_udf("int")
    def range_of(space: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series(shared.value.of(space.to_numpy(), k.to_numpy(np.int64)))

    refs, known = refs.withColumn("r", range_of("space", "k")), known.withColumn("r", range_of("space", "k"))
    per = {x["r"]: x["n"] for x in refs.groupBy("r").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per range
    slices = sc.broadcast(np.array([max(1, math.ceil(per.get(r, 0) / SLICE_ROWS)) for r in range(ranges.n)], np.int64))

    @F.pandas_udf("int")
    def slices_of(r: pd.Series) -> pd.Series:
        return pd.Series(slices.value[r.to_numpy()].astype(np.int32))

    refs = refs.withColumn("slice", F.pmod(F.xxhash64("row_id", "field"), slices_of("r")).cast("int"))
    known = known.withColumn("slice", F.explode(F.sequence(F.lit(0), slices_of("r") - 1)))
    probed = (
        refs.select("r", "slice", "field", "row_id", "space", "k", "s", "t")
        .groupBy("r", "slice")
        .cogroup(known.select("r", "slice", "space", "kind", "k", "s", "a", "b").groupBy("r", "slice"))
        .applyInPandas(_probe, "field int, row_id long, t double, why int")
    )

    def named(values: dict, by: str) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col(by))

    return probed.select(
        named({k: v[0] for k, v in FIELDS.items()}, "field").alias("table_name"),
        named({k: v[1] for k, v in FIELDS.items()}, "field").alias("ref_field"),
        "row_id",
        month_of(F.col("t")).alias("period"),
        named(REASONS, "why").alias("reason"),
    )


def report(found: DataFrame) -> DataFrame:
    """Misses per table, field, period and reason (partial aggregation before the shuffle)."""
    return found.groupBy("table_name", "ref_field", "period", "reason").agg(F.count(F.lit(1)).alias("n_refs"))

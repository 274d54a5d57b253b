"""Near-duplicate documents: all pairs whose sets of word n-grams have a Jaccard similarity of at least t.

Vertical partitioning. The global order of n-grams (by 64-bit hash) is cut into FRAGMENTS ranges. Each
fragment holds its own segment of every document; overlaps of candidate pairs are counted per fragment by
merging sorted segments, and the partial counts are summed per pair. The sum is the exact intersection, so
every reported pair is verified exactly.

Counting overlaps for all pairs that share any n-gram is quadratic in the corpus (on templated text an
n-gram's number of documents grows with the corpus), so the pairs that are counted are those whose segment
heads agree: under each of BANDS x ROWS orders of the n-grams a document has a head, its least n-gram; a
pair is a candidate if in at least MIN_HITS bands all ROWS heads are equal. A pair of similarity s agrees on
a head with probability s, so a pair at exactly s = 0.6 is missed with probability 8e-8 (at 0.8: 1e-23); the
candidate search covers every document and has no cap.

Skew. Documents with equal n-gram sets are collapsed to a representative before any pair is formed. The
documents of a band key are paired within a task only up to HOT of them; larger keys are cut into blocks
whose pairs of blocks are spread over tasks.

Defined results. Null texts and texts with fewer than n words have no n-grams and are in no pair. Repeated
rows of a document count once; a doc_id is never paired with itself. Empty tables give empty results. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from mnemic.llm import words
from mnemic.operators.components import components
from mnemic.session import materialize, spread

NGRAM, THRESHOLD = 3, 0.6
BANDS, ROWS, MIN_HITS = 80, 3, 2
FRAGMENTS = 8
#: Members of a band key that one task pairs; ids that may be broadcast (8 bytes each).
HOT, BROADCAST_IDS = 256, 2_000_000


def _multipliers(n: int) -> np.ndarray:
    return (words.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _sets(code: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, flat, and where each text's begin."""
    h, at = words.runs(code, starts, n)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(at)))


def _sketch(n: int, bands: int, rows: int):
    names = ["doc_id", "size", "sig", "keys"]
    types = [pa.int64(), pa.int32(), pa.binary(16), pa.list_(pa.int64())]
    by = _multipliers(bands * rows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            h, at = _sets(*words.flatten(batch.column("text").to_pylist()), n)
            sizes = np.diff(at)
            live = np.flatnonzero(sizes)
            if not len(live):
                continue
            low = (h ^ (h >> np.uint64(32))).astype(np.uint32)
            keys = np.empty((len(live), bands), np.uint64)
            for b in range(bands):
                key = words.mix(np.full(len(live), b + 1, np.uint64))
                for r in range(rows):
                    m = by[b * rows + r]
                    head = np.minimum.reduceat((low * m) ^ ((low * m) >> np.uint32(15)), at[live])
                    key = words.mix(key ^ head.astype(np.uint64))
                keys[:, b] = key
            sigs = [xxhash.xxh3_128_digest(h[at[i] : at[i + 1]].tobytes()) for i in live]
            offsets = pa.array(np.arange(len(live) + 1, dtype=np.int32) * bands)
            yield pa.RecordBatch.from_arrays([pa.array(ids[live]), pa.array(sizes[live].astype(np.int32)), pa.array(sigs, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1).view(np.int64)))], names=names)

    return scan


def sketches(documents: DataFrame, n: int = NGRAM, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, size, sig, keys): number of distinct n-grams, digest of their set, and the band keys."""
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id is not null and text is not null")
    return spread(docs).mapInArrow(_sketch(n, bands, rows), "doc_id long, size int, sig binary, keys array<long>")


def _close(sa: str, sb: str, t: float) -> Column:
    """Whether two sets of these sizes can have similarity t."""
    return F.least(sa, sb) >= F.lit(t) * F.greatest(sa, sb) - 1e-9


def candidates(reps: DataFrame, t: float, min_hits: int = MIN_HITS) -> DataFrame:
    """(a, b, size_a, size_b), a < b, of representatives that agree in at least ``min_hits`` bands."""
    # most keys belong to one document only: the rows that are left are written once and all else reads them
    keyed = reps.select("doc_id", "size", F.explode("keys").alias("key")).repartition("key")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    live = materialize(keyed.join(shared, "key"), "keys")

    def paired(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        x = left.select(*on, F.col("doc_id").alias("a"), F.col("size").alias("size_a"))
        y = right.select(*on, F.col("doc_id").alias("b"), F.col("size").alias("size_b"))
        return x.join(y, on).filter((F.col("a") < F.col("b")) & _close("size_a", "size_b", t)).select("a", "b", "size_a", "size_b")

    cold = live.filter(F.col("n") <= HOT)
    pairs = paired(cold, cold, ["key"])
    # a hot key's members are dealt into blocks; each unordered pair of blocks is one group of its own
    hot = live.filter(F.col("n") > HOT).withColumn("blocks", F.ceil(F.col("n") / HOT).cast("int")).withColumn("i", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    every = hot.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.struct(F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi")).alias("cell")
    cells = every.select("key", "doc_id", "size", "i", side)
    one = F.col("cell.lo") == F.col("cell.hi")
    # members of one block meet in every cell of their block; their pairs count in the cell of that block alone
    x = cells.select("key", "cell", F.col("i").alias("ia"), F.col("doc_id").alias("a"), F.col("size").alias("size_a"))
    y = cells.select("key", "cell", F.col("i").alias("ib"), F.col("doc_id").alias("b"), F.col("size").alias("size_b"))
    met = x.join(y, ["key", "cell"]).filter((F.col("a") < F.col("b")) & _close("size_a", "size_b", t) & (one | (F.col("ia") != F.col("ib"))))
    pairs = pairs.unionByName(met.select("a", "b", "size_a", "size_b")) if _any(hot) else pairs
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("hits"), F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b")).filter(F.col("hits") >= min_hits).drop("hits")


def _any(df: DataFrame) -> bool:
    return bool(df.limit(1).collect())


def _segments(n: int, fragments: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            h, at = _sets(*words.flatten(batch.column("text").to_pylist()), n)
            edges = (np.arange(1, fragments, dtype=np.uint64) * np.uint64(2**64 // fragments)).astype(np.uint64)
            doc, frag, seg = [], [], []
            for i in range(len(ids)):
                own = h[at[i] : at[i + 1]]
                for f, part in enumerate(np.split(own, np.searchsorted(own, edges))):
                    if len(part):
                        doc.append(int(ids[i]))
                        frag.append(f)
                        seg.append(part.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(frag, pa.int32()), pa.array(seg, pa.binary())], names=["doc_id", "fragment", "grams"])

    return scan


@F.pandas_udf(IntegerType())
def _overlap(x: pd.Series, y: pd.Series) -> pd.Series:
    """Partial overlap of two sorted segments."""
    return pd.Series([len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True)) for a, b in zip(x, y, strict=True)], dtype="int32")


def _only(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents with these ids: by a broadcast set where their counted number allows, else by a join."""
    docs = spread(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("text is not null"))
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")
    return docs.join(wanted, "doc_id", "left_semi")


def verified(documents: DataFrame, pairs: DataFrame, n: int, t: float, fragments: int = FRAGMENTS) -> DataFrame:
    """Pairs of similarity t or more with their exact ``overlap``: partial counts per fragment, summed."""
    ids = materialize(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    segments = _only(documents, ids).mapInArrow(_segments(n, fragments), "doc_id long, fragment int, grams binary")
    segments = materialize(segments, "segments")
    x = segments.select(F.col("doc_id").alias("a"), "fragment", F.col("grams").alias("x"))
    y = segments.select(F.col("doc_id").alias("b"), "fragment", F.col("grams").alias("y"))
    partial = pairs.join(x, "a").join(y, ["b", "fragment"]).select("a", "b", "fragment", "size_a", "size_b", _overlap("x", "y").alias("part"))
    # repeated rows of a document have equal segments, of which one counts
    once = partial.groupBy("a", "b", "fragment").agg(F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"), F.max("part").alias("part"))
    total = once.groupBy("a", "b").agg(F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"), F.sum("part").alias("overlap"))
    return total.filter(F.col("overlap") >= F.lit(t) * (F.col("size_a") + F.col("size_b") - F.col("overlap")) - 1e-9)


class NearDuplicates:
    """The steps that all results share, each written once: members (doc_id, rep, size) and links between
    representatives (a, b, overlap, size_a, size_b)."""

    def __init__(self, documents: DataFrame, n: int = NGRAM, t: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, min_hits: int = MIN_HITS) -> None:
        sketched = materialize(sketches(documents, n, bands, rows), "sketches")
        first = sketched.groupBy("sig").agg(F.min("doc_id").alias("rep"))
        self.members = materialize(sketched.select("doc_id", "size", "sig").join(first, "sig").select("doc_id", "rep", "size").distinct(), "members")
        # representatives keep their sketches where they are: copies, usually few, are taken out by id
        copies = self.members.filter("doc_id <> rep").select("doc_id").distinct()
        reps = sketched.join(F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies.hint("merge"), "doc_id", "left_anti")
        if sketched.count() != self.members.count():  # repeated rows
            reps = reps.dropDuplicates(["doc_id"])
        pairs = materialize(candidates(reps, t, min_hits), "pairs")
        self.links = materialize(verified(documents, pairs, n, t), "links")

    def pairs(self) -> DataFrame:
        """(doc_a, doc_b), doc_a < doc_b: every similar pair, copies expanded."""
        copies = self.members.filter("doc_id <> rep").select(F.col("rep"), F.col("doc_id").alias("copy"))
        grouped = self.members.join(copies.select("rep").distinct(), "rep", "left_semi").select("rep", "doc_id")
        within = grouped.select("rep", F.col("doc_id").alias("doc_a")).join(grouped.select("rep", F.col("doc_id").alias("doc_b")), "rep").filter("doc_a < doc_b").select("doc_a", "doc_b")
        of = self.members.select("rep", "doc_id")
        across = self.links.select("a", "b").join(of.select(F.col("rep").alias("a"), F.col("doc_id").alias("x")), "a").join(of.select(F.col("rep").alias("b"), F.col("doc_id").alias("y")), "b").filter("x <> y")
        return across.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).unionByName(within).distinct()

    def classes(self) -> DataFrame:
        """(doc_id, class_id, n_links): every document that has words enough, with the smallest id of its
        class (connected by similar pairs) and its number of similar documents."""
        joined = components(self.links.select("a", "b"))
        weight = self.members.groupBy("rep").agg(F.count(F.lit(1)).alias("w"))
        ends = self.links.select(F.col("a").alias("rep"), F.col("b").alias("other")).union(self.links.select("b", "a"))
        links = ends.join(weight.withColumnRenamed("rep", "other"), "other").groupBy("rep").agg(F.sum("w").alias("far"))
        out = self.members.join(weight, "rep").join(links, "rep", "left").join(joined.select(F.col("id").alias("rep"), "component"), "rep", "left")
        return out.select("doc_id", F.coalesce("component", "rep").alias("class_id"), (F.coalesce("far", F.lit(0)) + F.col("w") - 1).alias("n_links"))

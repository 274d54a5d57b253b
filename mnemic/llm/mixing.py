"""Mixing sources to target weights.

Each source gets its target share of the total number of tokens; the total is the largest at which no
source must repeat a document more often than it may. A source's documents stand in a fixed pseudo-random
order (a hash of the id); whole passes over the source and one partial pass, cut at the document where the
quota is reached, make up its part.

What is selected is then spread over output shards by a multivariate-hypergeometric splitting tree: the
root holds every source's exact number of blocks (runs of the permuted order), each node splits its counts
between its halves as a draw without replacement would, and the leaves' counts are the shards' exact
quotas (the tree is descended where needed, never built). A shard's blocks are consecutive places of an affine permutation of the source's blocks, hence
disjoint; rows are shuffled within their shard only. Nothing but counts per source and per (source, bucket)
reaches the driver: at most (sources) x BUCKETS rows; and no source is ever gathered in one task, except
for the documents of one of its BUCKETS buckets, in which the partial pass ends.

Defined results. A null or empty text has 0 tokens and is never selected; null sources and sources without
a target are not selected and are reported with target share 0. A target source without tokens is reported
with actual share 0. Rows with equal ids are one document per row (each may be used ``max_repeats`` times).
A target share or a ``max_repeats`` that is null, NaN or not positive counts as 0. Empty tables give an
empty selection.
"""

from __future__ import annotations

import base64
import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemic.session import materialize, spread

#: Place of the public tokenizer's ranks and its splitting pattern.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUCKETS = 4096
#: Documents of a block, tokens of a shard, and nodes near the root of the splitting tree that a task remembers.
BLOCK_DOCS, SHARD_TOKENS, NODES = 16, 1 << 18, 1 << 14
#: Items that are drawn from at a time.
DRAWN = 500_000_000
SEED = 20240229


@functools.lru_cache(2)
def _encoding(vocabulary: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, source, n_tokens) of every document with a source and at least one token."""

    with open(tokenizer, "rb") as f:  # read on the driver only: a vocabulary is a file of fixed size
        shared = documents.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(shared.value, pattern).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    docs = documents.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")).filter("doc_id is not null and source is not null and text <> ''")
    return spread(docs).mapInArrow(count, "doc_id long, source string, n_tokens long").filter("n_tokens > 0")


def _draw(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """n of the counted items without replacement. More than DRAWN items are drawn from in equal strata, as the
    generator is made for fewer."""
    strata = -(-int(counts.sum()) // DRAWN) or 1
    out = np.zeros_like(counts)
    for k in range(strata):
        part = counts * (k + 1) // strata - counts * k // strata if strata > 1 else counts
        want = n * (k + 1) // strata - n * k // strata
        out += rng.multivariate_hypergeometric(part, min(want, int(part.sum())), method="marginals")
    left = n - int(out.sum())
    if left > 0:  # strata of rounded counts may hold a few less than their share
        out += rng.multivariate_hypergeometric(np.minimum(counts - out, DRAWN // len(counts)), left, method="marginals")
    return out


class Tree:
    """The splitting tree over shards. A node's draw depends on the seed and the node only, so any task can descend to
    the shards it needs, and the tree is never built as a whole, however many shards there are."""

    def __init__(self, counts: np.ndarray, shards: int, seed: int) -> None:
        self.counts, self.shards, self.seed = np.asarray(counts, np.int64), shards, seed
        self._parts: dict[int, np.ndarray] = {}

    def _left(self, node: np.ndarray, size: int, number: int) -> np.ndarray:
        part = self._parts.get(number)
        if part is None:
            part = _draw(node, int(node.sum()) * (size // 2) // size, np.random.default_rng([self.seed, number]))
            if number < NODES:
                self._parts[number] = part
        return part

    def find(self, source: int, at: np.ndarray) -> np.ndarray:
        """Shards of blocks of a source, given by their places in the order in which shards draw them."""
        out = np.empty(len(at), np.int64)
        todo = [(self.counts, self.shards, 1, 0, np.arange(len(at)), np.asarray(at, np.int64))]
        while todo:
            node, size, number, first, rows, pos = todo.pop()
            if not len(rows):
                continue
            if size == 1:
                out[rows] = first
                continue
            part = self._left(node, size, number)
            mine = pos < part[source]
            todo.append((part, size // 2, 2 * number, first, rows[mine], pos[mine]))
            todo.append((node - part, size - size // 2, 2 * number + 1, first + size // 2, rows[~mine], pos[~mine] - part[source]))
        return out

    def leaves(self) -> np.ndarray:
        """All shards' counts, an array (shards, sources)."""
        out, todo = np.empty((self.shards, len(self.counts)), np.int64), [(self.counts, self.shards, 1, 0)]
        while todo:
            node, size, number, first = todo.pop()
            if size == 1:
                out[first] = node
                continue
            part = self._left(node, size, number)
            todo += [(part, size // 2, 2 * number, first), (node - part, size - size // 2, 2 * number + 1, first + size // 2)]
        return out


def _step(n: int, rng: np.random.Generator) -> int:
    """A multiplier coprime to n, for a permutation of range(n)."""
    while True:
        a = int(rng.integers(1, max(2, n)))
        if math.gcd(a, n) == 1:
            return a


def plan(totals: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, tuple[int, float]]:
    """For each source its whole passes and the tokens of its partial pass."""
    live = {s: (w, r) for s, (w, r) in targets.items() if w > 0 and r > 0 and totals.get(s, 0) > 0}
    if not live:
        return {}
    most = min(r * totals[s] / w for s, (w, r) in live.items())
    size = most if total is None else min(total, most)
    out = {}
    for s, (w, r) in live.items():
        passes = min(r, int(size * w / totals[s] + 1e-9))
        out[s] = (passes, 0.0 if passes == r else max(0.0, size * w - passes * totals[s]))
    return out


def _targets(mix_targets: DataFrame) -> dict[str, tuple[float, int]]:
    rows = mix_targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("r")).collect()
    return {x["source"]: (0.0 if x["w"] is None or math.isnan(x["w"]) else float(x["w"]), int(x["r"] or 0)) for x in rows}


def select(documents: DataFrame, mix_targets: DataFrame, total: float | None = None, seed: int = SEED, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens, repeats, place, block, ...): documents with the number of times each is used.

    ``place`` is the 63-bit position in the source's permuted order, ``block`` its run of that order.
    """
    sized = materialize(token_counts(documents, tokenizer).withColumn("place", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 1)), "sizes")
    targets = _targets(mix_targets)
    wanted = sized.filter(F.col("source").isin(list(targets))) if targets else sized.limit(0)
    bucket = F.shiftright("place", 51).cast("int")
    sums: dict[str, list[tuple[int, int, int]]] = {}
    for r in wanted.groupBy("source", bucket.alias("b")).agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs")).collect():
        sums.setdefault(r["source"], []).append((r["b"], r["n"], r["docs"]))
    quotas = plan({s: sum(x[1] for x in v) for s, v in sums.items()}, targets, total)
    rows = []
    for s, (passes, rest) in quotas.items():
        edge, before = BUCKETS, 0
        if rest > 0:
            for b, n, _ in sorted(sums[s]):
                if before + n > rest:
                    edge = b
                    break
                before += n
        else:
            edge = -1
        blocks = max(1, math.ceil(sum(x[2] for x in sums[s]) / BLOCK_DOCS))
        rows.append((s, passes, edge, float(rest - before), blocks))
    spark = documents.sparkSession
    quota = F.broadcast(spark.createDataFrame(rows, "source string, passes int, edge int, rest double, blocks long"))  # one row per target source
    docs = wanted.join(quota, "source").withColumn("b", bucket)
    cut = Window.partitionBy("source").orderBy("place", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = docs.filter("b = edge").withColumn("in_last", F.sum("n_tokens").over(cut) <= F.col("rest"))
    docs = last.unionByName(docs.filter("b <> edge").withColumn("in_last", F.col("b") < F.col("edge")))
    block = F.least(F.floor(F.col("place") / F.lit(2.0**63) * F.col("blocks")), F.col("blocks") - 1).cast("long")
    docs = materialize(docs.withColumn("block", block).drop("b", "edge"), "passes")
    # what the cut leaves open is filled by the one document, of those not in the partial pass, that comes nearest
    done = docs.filter("in_last").groupBy("source").agg(F.sum("n_tokens").alias("n"), F.max("block").alias("k")).collect()
    have = {r["source"]: (r["n"], r["k"]) for r in done}
    gaps = [(s, rest - have.get(s, (0, -1))[0], have.get(s, (0, -1))[1] + 1) for s, (_, rest) in quotas.items() if rest > 0]
    gap = F.broadcast(spark.createDataFrame(gaps, "source string, open double, next long"))  # one row per target source
    off = F.abs(F.col("n_tokens") - F.col("open"))
    near = docs.filter("not in_last").join(gap, "source").filter(off < F.col("open"))
    filler = F.broadcast(near.groupBy("source").agg(F.min_by(F.struct("place", "doc_id", "n_tokens"), F.struct(off, "place")).alias("pick"), F.first("next").alias("next")))
    docs = docs.join(filler, "source", "left").withColumn("fills", F.coalesce(F.struct("place", "doc_id", "n_tokens") == F.col("pick"), F.lit(False)))
    docs = docs.withColumn("in_last", F.col("in_last") | F.col("fills"))
    used = docs.withColumn("repeats", F.col("passes") + F.col("in_last").cast("int")).filter("repeats > 0")
    return used.select("doc_id", "source", "n_tokens", "repeats", "place", "block", "passes", "blocks", "in_last", F.when(F.col("fills"), F.col("next")).alias("own_block"))


def mix(documents: DataFrame, mix_targets: DataFrame, total: float | None = None, seed: int = SEED, tokenizer: str = TOKENIZER, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(shard, position, doc_id, copy, source, n_tokens): every use of a document with its shard and its
    place in the shard's shuffled order."""
    used = materialize(select(documents, mix_targets, total, seed, tokenizer), "selected")
    per = used.groupBy("source").agg(F.max("passes").alias("p"), F.max("blocks").alias("blocks"), F.max(F.when(F.col("in_last"), F.coalesce("own_block", "block"))).alias("last"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens")).orderBy("source").collect()
    names = [r["source"] for r in per]
    counts = np.array([r["p"] * r["blocks"] + (0 if r["last"] is None else r["last"] + 1) for r in per], np.int64)
    shards = max(1, math.ceil(sum(r["tokens"] for r in per) / shard_tokens)) if per else 1
    rng = np.random.default_rng(seed)
    tree = Tree(counts, shards, seed)
    turn = {s: (i, int(counts[i]), _step(int(counts[i]), rng), int(rng.integers(0, max(1, counts[i]))), r["blocks"]) for i, (s, r) in enumerate(zip(names, per, strict=True))}

    @F.pandas_udf("int")
    def shard_of(source: pd.Series, copy: pd.Series, block: pd.Series) -> pd.Series:
        out = np.zeros(len(source), np.int32)
        for s, (i, n, a, c, blocks) in turn.items():
            mine = (source == s).to_numpy()
            if mine.any():
                kind = np.int64 if n < 1 << 31 else object  # products of larger numbers need Python's integers
                u = copy.to_numpy()[mine].astype(kind) * blocks + block.to_numpy()[mine].astype(kind)
                at = ((u * a + c) % n).astype(np.int64)
                out[mine] = tree.find(i, at)
        return pd.Series(out)

    uses = used.select("doc_id", "source", "n_tokens", "block", "own_block", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)).alias("n"), "passes")
    # the partial pass is the last: its block numbers follow those of the whole passes, a filler's comes after them
    uses = uses.withColumn("block", F.when(F.col("n") == F.col("passes"), F.coalesce("own_block", "block")).otherwise(F.col("block")))
    uses = uses.withColumn("shard", shard_of("source", "n", "block"))
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "n"), "doc_id", "n", "n_tokens")
    return uses.select("shard", (F.row_number().over(order) - 1).alias("position"), "doc_id", F.col("n").alias("copy"), "source", "n_tokens")


def shares(documents: DataFrame, mix_targets: DataFrame, total: float | None = None, seed: int = SEED, tokenizer: str = TOKENIZER) -> DataFrame:
    """(source, target_share, max_repeats, n_docs, n_tokens, most_repeats, actual_share) per source."""
    used = select(documents, mix_targets, total, seed, tokenizer)
    per = used.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"), F.max("repeats").alias("most_repeats"))
    known = documents.filter("source is not null").select("source").union(mix_targets.filter("source is not null").select("source")).distinct()
    goal = mix_targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    whole = Window.partitionBy()  # one row per source
    out = known.join(per, "source", "left").join(goal, "source", "left").fillna({"n_docs": 0, "n_tokens": 0, "most_repeats": 0, "target_share": 0.0, "max_repeats": 0})
    return out.select("source", "target_share", "max_repeats", "n_docs", "n_tokens", "most_repeats", F.round(F.coalesce(F.col("n_tokens") / F.nullif(F.sum("n_tokens").over(whole), F.lit(0)), F.lit(0.0)), 6).alias("actual_share"))

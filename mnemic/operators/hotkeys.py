"""Per-key results where a few keys hold most records.

Rows are never moved by key. Each equal input split encodes its keys against a local dictionary and adds
them up with bincount; integer keys fall into dense blocks of BLOCK consecutive values, and what leaves a
split is one row of arrays per (side, block, relation). The blocks are summed in two rounds (first within
groups of splits, then over all), so a hot key costs each split one array slot and no task sees its rows.

Defined results. Rows with a null key are counted in no key. A null or NaN weight counts as 0. A null
relation is the relation ''. Sums are rounded to 4 decimals, which makes them independent of the order of
addition; of relations with equal rounded sums the alphabetically first is the strongest. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 4096
#: Groups of splits that are summed before the last round.
GROUPS = 32
_PARTS = "side string, block long, relation string, at binary, n binary, w binary"
_OUT = "side string, entity_id long, n_edges long, sum_weight double, top_relation string, top_weight double"


def canonical_relation(relation: Column) -> Column:
    """A relation without surrounding blanks, in lower case, blanks and hyphens as underscores."""
    return F.translate(F.lower(F.trim(relation)), " -", "__")


def _add(key: np.ndarray, n: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dictionary-encode, then scatter-add counts and weights."""
    words, code = np.unique(key, return_inverse=True)
    return words, np.bincount(code, n, len(words)).astype("int64"), np.bincount(code, w, len(words))


def _rows(side: str, relation: str, key: np.ndarray, n: np.ndarray, w: np.ndarray) -> Iterator[tuple]:
    """key is sorted: one row of arrays per block."""
    block = key // BLOCK
    ends = np.flatnonzero(np.diff(block)) + 1
    for part in np.split(np.arange(len(key)), ends):
        if len(part):
            b = int(block[part[0]])
            yield side, b, relation, (key[part] - b * BLOCK).astype("<u2").tobytes(), n[part].astype("<i8").tobytes(), w[part].astype("<f8").tobytes()


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names=names)


_NAMES = ["side", "block", "relation", "at", "n", "w"]
_TYPES = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary()]


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partial arrays of one input split; its memory is bounded by the split's distinct keys."""
    sums: dict[tuple[str, str], list] = {}
    for batch in batches:
        relation = batch.column("relation").dictionary_encode()
        words, code = relation.dictionary.to_pylist(), relation.indices.to_numpy(zero_copy_only=False)
        w = np.nan_to_num(batch.column("weight").to_numpy(zero_copy_only=False).astype("float64"), nan=0.0)
        for side, column in (("head", "head_id"), ("tail", "tail_id")):
            keys = batch.column(column)
            ok = keys.is_valid().to_numpy(zero_copy_only=False)
            key = keys.fill_null(0).to_numpy(zero_copy_only=False)
            for i, word in enumerate(words):
                mine = ok & (code == i)
                if mine.any():
                    sums.setdefault((side, word), []).append(_add(key[mine], np.ones(mine.sum()), w[mine]))
        for k, parts in sums.items():
            if len(parts) > 8:
                sums[k] = [_add(*map(np.concatenate, zip(*parts, strict=True)))]
    rows = []
    for (side, word), parts in sums.items():
        rows += _rows(side, word, *_add(*map(np.concatenate, zip(*parts, strict=True))))
    yield _batch(rows, _NAMES, _TYPES)


class _Dense:
    """The arrays of one (side, block, relation)."""

    def __init__(self) -> None:
        self.n, self.w = np.zeros(BLOCK, "int64"), np.zeros(BLOCK)

    def add(self, at: bytes, n: bytes, w: bytes) -> None:
        i = np.frombuffer(at, "<u2")
        self.n[i] += np.frombuffer(n, "<i8")
        self.w[i] += np.frombuffer(w, "<f8")


def _sorted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in _NAMES), strict=True)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum arrays over rows sorted by (side, block, relation); one accumulator lives at a time."""
    now, acc, rows = None, _Dense(), []

    def done() -> None:
        i = np.flatnonzero(acc.n)
        rows.append((*now, i.astype("<u2").tobytes(), acc.n[i].tobytes(), acc.w[i].tobytes()))

    for *key, at, n, w in _sorted_rows(batches):
        if now is not None and key != now:
            done()
            acc = _Dense()
            if len(rows) >= 512:
                yield _batch(rows, _NAMES, _TYPES)
                rows = []
        now = key
        acc.add(at, n, w)
    if now is not None:
        done()
    yield _batch(rows, _NAMES, _TYPES)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per entity totals and strongest relation, from rows sorted by (side, block, relation)."""
    names = ["side", "entity_id", "n_edges", "sum_weight", "top_relation", "top_weight"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.float64()]
    now, one = None, _Dense()

    def fresh() -> tuple:
        return _Dense(), np.full(BLOCK, -np.inf), np.full(BLOCK, None, object)

    total, best, word = fresh()

    def close_relation(relation: str) -> None:
        total.n += one.n
        total.w += one.w
        better = (one.n > 0) & (np.round(one.w, 4) > best)
        best[better] = np.round(one.w[better], 4)
        word[better] = relation

    def close_block(side: str, block: int) -> pa.RecordBatch:
        i = np.flatnonzero(total.n)
        return pa.RecordBatch.from_arrays([pa.array([side] * len(i), types[0]), pa.array(i + block * BLOCK, types[1]), pa.array(total.n[i]), pa.array(np.round(total.w[i], 4) + 0.0), pa.array(word[i].tolist(), types[4]), pa.array(best[i] + 0.0)], names=names)

    for *key, at, n, w in _sorted_rows(batches):
        if now is not None and key != now:
            close_relation(now[2])
            one = _Dense()
            if key[:2] != now[:2]:
                yield close_block(*now[:2])
                total, best, word = fresh()
        now = key
        one.add(at, n, w)
    if now is not None:
        close_relation(now[2])
        yield close_block(*now[:2])


def key_totals(edges: DataFrame) -> DataFrame:
    """(side, entity_id, n_edges, sum_weight, top_relation, top_weight) of every head and tail."""
    rows = edges.select("head_id", "tail_id", F.coalesce(canonical_relation(F.col("relation")), F.lit("")).alias("relation"), F.col("weight").cast("double").alias("weight"))
    order = ["side", "block", "relation"]
    parts = rows.mapInArrow(_split, _PARTS).withColumn("g", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    some = parts.repartition("side", "block", "g").sortWithinPartitions(*order).drop("g").mapInArrow(_combine, _PARTS)
    return some.repartition("side", "block").sortWithinPartitions(*order).mapInArrow(_finish, _OUT)


def hot_keys(totals: DataFrame, n_rows: int, share: float = 0.025) -> DataFrame:
    """(side, entity_id, n_edges) of keys that hold at least ``share`` of all rows."""
    return totals.filter((F.col("n_edges") >= F.lit(share) * n_rows) & (F.lit(n_rows) > 0)).select("side", "entity_id", "n_edges")

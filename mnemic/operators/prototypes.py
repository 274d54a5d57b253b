"""Prototype memory: one bundle per class, nearest-prototype prediction with margin, separability.

Similarities are matrix products in Arrow batches: each batch of samples is multiplied with the prototypes (or
the stated query vectors), which are broadcast in blocks of a bounded number of bytes. What leaves a task is one row
per sample and block (the two best classes) or k rows per query, so nothing is shuffled that grows with samples x
classes. Vectors of another length than the prototypes' have no score; NaN and infinite elements count as 0.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from mnemic.functions import vectors as V

#: Bytes of vectors in one broadcast block; elements of one similarity matrix.
BLOCK_BYTES, MATRIX = 64 << 20, 1 << 22


def fit(samples: DataFrame, label: str = "label", vector: str = "hv") -> DataFrame:
    """(label, hv): unit-length bundle per class. Null labels are left out."""
    rows = samples.filter(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(label).alias("label"), F.col(vector).alias("hv"))
    return V.assembled(V.bundle_real(rows, ["label"]), ["label"])


def update(old: DataFrame, samples: DataFrame) -> DataFrame:
    """Re-bundle prototypes with new samples: bundle(samples and the present prototype) per class."""
    return fit(old.select("label", "hv").unionByName(samples.select("label", "hv")))


def _dense(column: pa.ChunkedArray | pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of the vectors of length ``dim`` (zero vectors stay zero), and which rows have that length."""
    size = np.asarray(pa.compute.list_value_length(column).fill_null(-1))
    ok = size == dim
    kept = column.filter(pa.array(ok)) if not ok.all() else column
    flat = np.nan_to_num(np.asarray(kept.flatten().fill_null(0.0), dtype=float), nan=0.0, posinf=0.0, neginf=0.0)
    x = flat.reshape(-1, dim)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1.0, n), ok


class _Block:
    """Named vectors of one length that are sent to all tasks."""

    def __init__(self, names: list, vectors: list, kind: pa.DataType) -> None:
        self.dim = len(vectors[0])
        x = np.nan_to_num(np.array(vectors, dtype=float), nan=0.0, posinf=0.0, neginf=0.0)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        self.names, self.x = pa.array(names, kind), x / np.where(n == 0, 1.0, n)


def _blocks(named: DataFrame) -> Iterator[_Block]:
    """Blocks of the (name, hv) rows, streamed to the driver one partition at a time; a block's size is bounded and
    its vectors have one length."""
    kind = to_arrow_type(named.schema["name"].dataType)
    open_: dict[int, tuple[list, list]] = {}
    for name, hv in named.filter("name is not null and hv is not null and size(hv) > 0").orderBy("name").toLocalIterator():
        names, vectors = open_.setdefault(len(hv), ([], []))
        names.append(name)
        vectors.append([0.0 if v is None else v for v in hv])
        if 8 * len(hv) * len(names) >= BLOCK_BYTES:
            yield _Block(*open_.pop(len(hv)), kind)
    for names, vectors in open_.values():
        yield _Block(names, vectors, kind)


def _products(block: _Block, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, similarities of these rows to the block's vectors), a bounded matrix at a time."""
    x, ok = _dense(column, block.dim)
    rows = np.flatnonzero(ok)
    step = max(1, MATRIX // len(block.names))
    for a in range(0, len(rows), step):
        yield rows[a : a + step], np.round(x[a : a + step] @ block.x.T, 9)


def scores(samples: DataFrame, prototypes: DataFrame, key: str) -> DataFrame:
    """(key, label, score): similarity of every sample to every prototype of its length."""
    return _over_blocks(samples, prototypes, key, _all_scores, "label")


def ranked(samples: DataFrame, prototypes: DataFrame, key: str) -> DataFrame:
    """(key, rank, label, score): the classes of each sample in descending order of score, ties to the smaller label."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "label")
    return scores(samples, prototypes, key).withColumn("rank", F.row_number().over(w)).select(key, "rank", "label", "score")


def _all_scores(block: _Block, ids: pa.Array, column: pa.Array) -> list[pa.Array]:
    out: list[tuple] = []
    for rows, s in _products(block, column):
        out.append((np.repeat(rows, s.shape[1]), np.tile(np.arange(s.shape[1]), len(rows)), s.ravel()))
    at, of, s = (np.concatenate(c) if out else np.zeros(0, int) for c in (zip(*out, strict=True) if out else ([], [], [])))
    return [ids.take(pa.array(at, pa.int64())), block.names.take(pa.array(of, pa.int64())), pa.array(np.asarray(s, float))]


def _best_two(block: _Block, ids: pa.Array, column: pa.Array) -> list[pa.Array]:
    """The two best classes of each sample; names are sorted, so the first maximum is the smallest label."""
    at, of, best = [], [], []
    for rows, s in _products(block, column):
        for _ in range(min(2, s.shape[1])):
            i = s.argmax(1)
            at.append(rows)
            of.append(i)
            best.append(s[np.arange(len(rows)), i])
            s[np.arange(len(rows)), i] = -np.inf
    at, of, best = (np.concatenate(c) if c else np.zeros(0) for c in (at, of, best))
    return [ids.take(pa.array(at.astype(int), pa.int64())), block.names.take(pa.array(of.astype(int), pa.int64())), pa.array(np.asarray(best, float))]


def _over_blocks(samples: DataFrame, prototypes: DataFrame, key: str, rows_of, name: str) -> DataFrame:
    sc = samples.sparkSession.sparkContext
    kinds = {f.name: f.dataType.simpleString() for f in (*samples.schema, *prototypes.schema)}
    schema = f"`{key}` {kinds[key]}, {name} {kinds[name]}, score double"
    vectors = samples.select(key, F.col("hv").cast("array<double>").alias("hv")).filter("hv is not null")
    out = samples.sparkSession.createDataFrame([], schema)
    for block in _blocks(prototypes.select(F.col(name).alias("name"), F.col("hv").cast("array<double>").alias("hv"))):
        shared = sc.broadcast(block)  # at most about BLOCK_BYTES

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays(rows_of(shared.value, batch.column(0), batch.column(1)), names=[key, name, "score"])

        out = out.unionByName(vectors.mapInArrow(scan, schema))
    return out


def predict(samples: DataFrame, prototypes: DataFrame, key: str) -> DataFrame:
    """(key, predicted, score, margin): best class, and its lead over the second (its score if single)."""
    two = _over_blocks(samples, prototypes, key, _best_two, "label")
    best = two.groupBy(key).agg(F.min_by(F.struct("label", "score"), F.struct((-F.col("score")).alias("s"), "label")).alias("top"), F.sort_array(F.collect_list("score"), asc=False).alias("s"))  # two of each block
    second = F.get("s", F.lit(1))
    return best.select(key, F.col("top.label").alias("predicted"), F.round("top.score", 6).alias("score"), F.round(F.when(second.isNull(), F.col("top.score")).otherwise(F.col("top.score") - second), 6).alias("margin"))


def separability(components: DataFrame, prototypes: DataFrame) -> DataFrame:
    """(component, alignment, separation, ratio) from component vectors (component, label, hv): mean own
    similarity, mean lead over the strongest competitor, and separation / max(|alignment|, 1e-8). Labels
    without a prototype are ignored; with one class the competitor is 0."""
    keyed = components.join(prototypes.select("label"), "label", "left_semi").withColumn("k", F.concat_ws("|", "component", "label"))
    s = scores(keyed.select("k", "hv"), prototypes, "k").join(keyed.select("k", "component", F.col("label").alias("own")), "k")
    per = s.groupBy("component", "own").agg(F.max(F.when(F.col("label") == F.col("own"), F.col("score"))).alias("mine"), F.coalesce(F.max(F.when(F.col("label") != F.col("own"), F.col("score"))), F.lit(0.0)).alias("rival"))
    out = per.groupBy("component").agg(F.avg("mine").alias("alignment"), F.avg(F.col("mine") - F.col("rival")).alias("separation"))
    return out.select("component", F.round("alignment", 6).alias("alignment"), F.round("separation", 6).alias("separation"), F.round(F.col("separation") / F.greatest(F.abs("alignment"), F.lit(1e-8)), 6).alias("ratio"))


def top_k(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): the k vectors nearest to each query vector (query_id, hv), by exhaustive
    search. Queries go in blocks, each broadcast in turn; a task sends k rows per query."""
    spark = vectors.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in (*queries.schema, *vectors.schema)}
    schema = f"query_id {kinds['query_id']}, vec_id {kinds['vec_id']}, score double"
    types = [to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(vectors.schema["vec_id"].dataType), pa.float64()]
    rows = vectors.select("vec_id", F.col("hv").cast("array<double>").alias("hv")).filter("hv is not null")
    out = spark.createDataFrame([], schema)
    for block in _blocks(queries.select(F.col("query_id").alias("name"), F.col("hv").cast("array<double>").alias("hv"))):
        shared = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            b: _Block = shared.value
            heaps: list[list[tuple[float, int]]] = [[] for _ in b.names]
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for at, s in _products(b, batch.column(1)):
                    for j, heap in enumerate(heaps):
                        column = s[:, j]
                        floor = heap[0][0] if len(heap) == k else -np.inf
                        for i in np.flatnonzero(column >= floor):
                            item = (float(column[i]), -ids[at[i]])
                            if len(heap) < k:
                                heapq.heappush(heap, item)
                            elif item > heap[0]:
                                heapq.heapreplace(heap, item)
            rows = [(n, -v, s) for n, heap in zip(b.names.to_pylist(), heaps, strict=True) for s, v in heap]
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["query_id", "vec_id", "score"])

        out = out.unionByName(rows.mapInArrow(scan, schema))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("score", F.round("score", 6))

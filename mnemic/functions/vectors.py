"""Hypervector algebra as column expressions over array columns, and bundles as aggregations.

Everything is built from higher-order functions and arithmetic, so it runs inside the JVM. Null vectors give
null; vectors of unequal length give null from the functions of two vectors; NaN and infinite elements count
as 0 in similarities.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, DoubleType

#: Default numbers of dimensions of real and ternary vectors.
REAL_DIM, TERNARY_DIM = 10_000, 16_000
#: Dimensions of text vectors.
TEXT_DIM = 96


def _finite(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull(), 0.0).otherwise(x)


def _same(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value)


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def bind(a: Column, b: Column) -> Column:
    """Element-wise product."""
    return _same(a, b, F.zip_with(a, b, lambda x, y: x * y))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: _finite(x) * _finite(y)), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return _same(a, b, F.when(norms > 0, dot(a, b) / norms).otherwise(0.0))


def quantize(a: Column, deadband: float) -> Column:
    """Signs, with 0 for magnitudes up to the deadband."""
    return F.transform(a, lambda x: F.when(F.abs(_finite(x)) <= deadband, 0).otherwise(F.signum(_finite(x)).cast("int")))


def ternary_similarity(a: Column, b: Column) -> Column:
    """(matches - mismatches) / positions where both are set; 0 where there is none."""
    both = F.zip_with(a, b, lambda x, y: x * y)
    n = F.aggregate(both, F.lit(0), lambda acc, x: acc + F.abs(x))
    return _same(a, b, F.when(n > 0, F.aggregate(both, F.lit(0), lambda acc, x: acc + x) / n).otherwise(0.0))


def pack_trits(a: Column) -> Column:
    """Two bits per trit (0, 1 and 2 for 0, +1 and -1), four to a byte from the lowest bits, zero padded."""
    code = F.transform(a, lambda x: F.when(x == 1, 1).when(x == -1, 2).otherwise(0))
    n = F.size(a)
    byte = F.transform(
        F.sequence(F.lit(0), F.ceil(n / 4).cast("int") - 1),
        lambda i: F.lpad(F.hex(sum(F.coalesce(F.get(code, i * 4 + k), F.lit(0)) * 4**k for k in range(4)).cast("long")), 2, "0"),
    )
    return F.when(n > 0, F.unhex(F.array_join(byte, ""))).when(n == 0, F.lit(b""))


def unpack_trits(blob: Column, dim: Column) -> Column:
    """Trits of a packed vector; the unused code 3 reads as 0. An error where the size does not fit."""
    digits = F.hex(blob)
    byte = lambda i: F.conv(F.substr(digits, (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    trit = lambda i: F.shiftright(byte(F.floor(i / 4)), 0) / F.pow(F.lit(4), i % 4)
    code = lambda i: F.floor(trit(i)).cast("int") % 4
    out = F.transform(F.sequence(F.lit(0), dim - 1), lambda i: F.when(code(i) == 1, 1).when(code(i) == 2, -1).otherwise(0))
    fits = F.length(blob) == F.ceil(dim / 4)
    return F.when(dim == 0, F.array().cast("array<int>")).when(fits, out).otherwise(F.raise_error(F.lit("packed vector has the wrong size")).cast("array<int>"))


@F.pandas_udf(BinaryType())
def pack_real(vectors: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats, the wire form of real vectors."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(ArrayType(DoubleType()))
def unpack_real(blobs: pd.Series, dims: pd.Series) -> pd.Series:
    """Vectors of the stated numbers of dimensions; an error where the size does not fit."""
    out = []
    for b, dim in zip(blobs, dims, strict=True):
        if b is not None and len(b) != 4 * dim:
            raise ValueError(f"packed vector has {len(b)} bytes, not {4 * dim}")
        out.append(None if b is None else np.frombuffer(b, "<f4").astype("float64"))
    return pd.Series(out)


def planes(a: Column) -> Column:
    """Bit planes of a ternary vector: struct of two arrays of 64-bit words, for +1 and -1."""
    words = F.ceil(F.size(a) / 64).cast("int")

    powers = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))

    def plane(sign: int) -> Column:
        part = lambda w: F.zip_with(F.slice(a, w * 64 + 1, F.lit(64)), powers, lambda x, p: F.when(x == sign, p).otherwise(F.lit(0).cast("long")))
        return F.transform(F.sequence(F.lit(0), words - 1), lambda w: F.aggregate(part(w), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x)))

    return F.struct(plane(1).alias("pos"), plane(-1).alias("neg"))


def planes_trits(p: Column, dim: Column) -> Column:
    """The ternary vector of bit planes."""
    bit = lambda words, i: F.call_function("shiftright", F.element_at(words, (F.floor(i / 64) + 1).cast("int")), (i % 64).cast("int")).bitwiseAND(F.lit(1).cast("long"))
    return F.when(dim == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), dim - 1), lambda i: (bit(p["pos"], i) - bit(p["neg"], i)).cast("int")))


def planes_bind(a: Column, b: Column) -> Column:
    def both(p: Column, q: Column, r: Column, s: Column) -> Column:
        return F.zip_with(F.zip_with(p, q, lambda x, y: x.bitwiseAND(y)), F.zip_with(r, s, lambda x, y: x.bitwiseAND(y)), lambda x, y: x.bitwiseOR(y))

    return F.struct(both(a["pos"], b["pos"], a["neg"], b["neg"]).alias("pos"), both(a["pos"], b["neg"], a["neg"], b["pos"]).alias("neg"))


def planes_similarity(a: Column, b: Column) -> Column:
    bound = planes_bind(a, b)
    ones = lambda x: F.aggregate(x, F.lit(0), lambda acc, w: acc + F.bit_count(w))
    same, odd = ones(bound["pos"]), ones(bound["neg"])
    return F.when(same + odd > 0, (same - odd) / (same + odd)).otherwise(0.0)


def exploded(df: DataFrame, keys: list[str], vector: str = "hv", weight: str | None = None) -> DataFrame:
    """(keys, pos, x[, n]) of every element."""
    return df.select(*keys, *([F.col(weight).alias("n")] if weight else []), F.posexplode(vector).alias("pos", "x"))


#: Elements of all accumulators that a split keeps before it sends them on.
HELD = 1 << 22


class _Sums:
    """Dense sums per key; vectors of a key may differ in length."""

    def __init__(self) -> None:
        self.sums: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        self.held = 0

    def add(self, key: tuple, s: np.ndarray, n: np.ndarray) -> None:
        old = self.sums.get(key)
        if old is not None and len(old[0]) >= len(s):
            old[0][: len(s)] += s
            old[1][: len(n)] += n
            return
        if old is not None:
            s, n = s.copy(), n.copy()
            s[: len(old[0])] += old[0]
            n[: len(old[0])] += old[1]
            self.held -= len(old[0])
        self.sums[key] = s, n
        self.held += len(s)


def _accumulate(n_keys: int, names: list[str], types: list[pa.DataType]):
    """Sums of one input split: rows (keys, vector, weight) in, one row (keys, s, n) per key out."""

    def batch_of(sums: _Sums) -> pa.RecordBatch:
        cols = list(zip(*sums.sums, strict=True)) or [()] * n_keys
        arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
        arrays.append(pa.array([s for s, _ in sums.sums.values()], pa.list_(pa.float64())))
        arrays.append(pa.array([n for _, n in sums.sums.values()], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(arrays, names=[*names, "s", "n"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(n_keys)), strict=True))
            hv, w = batch.column(n_keys), np.asarray(batch.column(n_keys + 1).fill_null(0), dtype=np.int64)
            size = np.asarray(pa.compute.list_value_length(hv).fill_null(0))
            x = np.nan_to_num(np.asarray(hv.flatten().fill_null(0.0), dtype=float), nan=0.0, posinf=0.0, neginf=0.0)
            at = np.concatenate(([0], np.cumsum(size)))
            groups: dict[tuple, list[int]] = {}
            for i, k in enumerate(keys):
                groups.setdefault((k, size[i]), []).append(i)
            for (k, dim), rows in groups.items():
                if dim:
                    part = x[(at[rows][:, None] + np.arange(dim)).ravel()].reshape(-1, dim) if len(rows) > 1 else x[at[rows[0]] : at[rows[0]] + dim][None, :]
                    sums.add(k, w[rows].astype(float) @ part, np.full(dim, w[rows].sum()))
            if sums.held > HELD:
                yield batch_of(sums)
                sums = _Sums()
        yield batch_of(sums)

    return scan


def _totals(df: DataFrame, keys: list[str], vector: str, weight: str | None) -> DataFrame:
    """(keys, pos, s, n): sums of elements (times weights) and of weights. A split adds its vectors up in dense arrays,
    so what is shuffled is a row per key and element of each split, not of each vector."""
    rows = df.select(*keys, F.col(vector).cast("array<double>").alias("hv"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("w")).filter("hv is not null")
    kinds = [rows.schema[k].dataType for k in keys]
    schema = ", ".join([f"`{k}` {t.simpleString()}" for k, t in zip(keys, kinds, strict=True)] + ["s array<double>", "n array<bigint>"])
    parts = rows.mapInArrow(_accumulate(len(keys), keys, [to_arrow_type(t) for t in kinds]), schema)
    each = parts.select(*keys, F.posexplode(F.arrays_zip("s", "n")).alias("pos", "e"))
    return each.groupBy(*keys, "pos").agg(F.sum("e.s").alias("s"), F.sum("e.n").alias("n"))


def bundle_real(df: DataFrame, keys: list[str], vector: str = "hv") -> DataFrame:
    """(keys, pos, x): sum of a key's vectors with unit length; a zero sum stays zero. A key's rows are never
    gathered."""
    total = _totals(df, keys, vector, None).drop("n")
    norm = total.groupBy(*keys).agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"))
    return total.join(norm, keys).select(*keys, "pos", F.when(F.col("norm") > 0, F.col("s") / F.col("norm")).otherwise(0.0).alias("x"))


def bundle_ternary(df: DataFrame, keys: list[str], vector: str = "hv", deadband: float = 0.0, weight: str | None = None) -> DataFrame:
    """(keys, pos, s, n, x): sign of the (weighted) sum with deadband max(0.5 * sqrt(n), deadband)."""
    total = _totals(df, keys, vector, weight).withColumn("s", F.col("s").cast("long"))
    t = F.greatest(0.5 * F.sqrt("n"), F.lit(deadband))
    return total.select(*keys, "pos", "s", "n", F.when(F.abs("s") <= t, 0).otherwise(F.signum("s").cast("int")).alias("x"))


def assembled(parts: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    """(keys, hv): elements put back in order. A vector is bounded by its number of dimensions."""
    return parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v")))).alias("e")).select(*keys, F.col("e.v").alias("hv"))


def random_basis(rows: int, dim: int, seed: int) -> np.ndarray:
    """Row-normalised Gaussian basis (generated once on the driver: rows x dim is a model parameter)."""
    b = np.random.default_rng(seed).standard_normal((rows, dim))
    n = np.linalg.norm(b, axis=1, keepdims=True)
    return b / np.where(n == 0, 1.0, n)


def text_hv(text: Column, salts: int = 1) -> Column:
    """A ternary vector of 32 x salts elements seeded by a text, the same in every engine with md5: a hex
    digit below 6 is -1, below 10 is 0, else +1."""
    digits = F.concat(*[F.md5(F.concat(F.lit(f"{i}:"), text)) for i in range(salts)])
    value = F.transform(F.sequence(F.lit(1), F.lit(32 * salts)), lambda i: F.conv(F.substr(digits, i, F.lit(1)), 16, 10).cast("int"))
    return F.when(text.isNotNull(), F.transform(value, lambda v: F.when(v < 6, -1).when(v < 10, 0).otherwise(1)))


def hashed_features(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Signed feature hashing of words, unit length: the text vectors that stand in for learned ones."""
    for batch in texts:
        out = []
        for t in batch:
            v = np.zeros(TEXT_DIM)
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                v[h % TEXT_DIM] += 1.0 if h >> 63 else -1.0
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        yield pd.Series(out)


text_vector = F.pandas_udf(hashed_features, ArrayType(DoubleType()))

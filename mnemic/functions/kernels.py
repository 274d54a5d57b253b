"""Kernels: one protocol for real and ternary hypervectors, chosen by name, and a place to add others.

A kernel has a number of dimensions and says how vectors are made (``symbol`` from a text as a seed, ``seed`` from a
text's features), bound, added up, settled and compared. Operators on elements (``settle``, ``alike``) work on sums
(s) of n vectors, so that bundles need not be assembled to be compared.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from mnemic.functions import vectors as V

#: Seed of the basis that text features are projected with.
TEXT_SEED = 1234


@functools.lru_cache(4)
def _text_basis(dim: int) -> np.ndarray:
    return V.random_basis(V.TEXT_DIM, dim, TEXT_SEED)


class Kernel:
    """What all kernels share; subclasses say how elements are made and settled."""

    name = ""

    def __init__(self, dim: int) -> None:
        if dim < 1:
            raise ValueError("a vector needs a dimension")
        self.dim = dim

    def zeros(self) -> Column:
        return V.zeros(self.dim)

    def basis(self, rows: int, seed: int) -> np.ndarray:
        return V.random_basis(rows, self.dim, seed)

    def elements(self, x: np.ndarray) -> np.ndarray:
        """Vectors from rows of real numbers."""
        raise NotImplementedError

    def symbol(self, text: Column) -> Column:
        """A random vector seeded by a text; null for null."""
        dim, elements = self.dim, self.elements

        @F.pandas_udf(ArrayType(DoubleType()))
        def run(texts: pd.Series) -> pd.Series:
            made = {t: elements(np.random.default_rng(int.from_bytes(hashlib.md5(t.encode()).digest()[:8], "little")).standard_normal((1, dim)))[0] for t in texts.dropna().unique()}
            return texts.map(lambda t: None if t is None else made[t])

        return run(text)

    def seed(self, text: Column) -> Column:
        """The vector of a text's features: their projection on a fixed basis; null counts as an empty text."""
        dim, elements = self.dim, self.elements

        @F.pandas_udf(ArrayType(DoubleType()))
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for features in V.hashed_features(batches):
                yield pd.Series(list(elements(np.stack(features.to_numpy()) @ _text_basis(dim))) if len(features) else [], dtype=object)

        return run(text)

    def bind(self, a: Column, b: Column) -> Column:
        return V.bind(a, b)

    def bundle(self, df: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
        """(keys, pos, s, n, x): sums over a key's vectors and the settled bundle."""
        total = V._totals(df, keys, "hv", weight)
        return total.select(*keys, "pos", "s", "n", self.settle(F.col("s"), F.col("n")).alias("x"))

    def settle(self, s: Column, n: Column) -> Column:
        """An element of a bundle from the sum of n elements."""
        raise NotImplementedError

    def similarity(self, a: Column, b: Column) -> Column:
        raise NotImplementedError

    def alike(self, x: Column, y: Column) -> Column:
        """Similarity as an aggregate over the elements of two vectors."""
        raise NotImplementedError


class Real(Kernel):
    name = "real"

    def elements(self, x: np.ndarray) -> np.ndarray:
        y = np.tanh(x)
        n = np.linalg.norm(y, axis=1, keepdims=True)
        return y / np.where(n == 0, 1.0, n)

    def settle(self, s: Column, n: Column) -> Column:
        return s.cast("double")

    def similarity(self, a: Column, b: Column) -> Column:
        return V.cosine(a.cast("array<double>"), b.cast("array<double>"))

    def alike(self, x: Column, y: Column) -> Column:
        norms = F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y))
        return F.when(norms > 0, F.sum(x * y) / norms).otherwise(0.0)

    def pack(self, a: Column) -> Column:
        return V.pack_real(a)

    def unpack(self, blob: Column) -> Column:
        return V.unpack_real(blob, F.lit(self.dim))


class Ternary(Kernel):
    name = "ternary"

    def __init__(self, dim: int, deadband: float = 0.0) -> None:
        super().__init__(dim)
        self.deadband = deadband

    def elements(self, x: np.ndarray) -> np.ndarray:
        return np.where(np.abs(x) <= self.deadband, 0.0, np.sign(x))

    def settle(self, s: Column, n: Column) -> Column:
        return F.when(F.abs(s) <= F.greatest(0.5 * F.sqrt(n), F.lit(self.deadband)), 0).otherwise(F.signum(s).cast("int"))

    def similarity(self, a: Column, b: Column) -> Column:
        return V.ternary_similarity(a.cast("array<int>"), b.cast("array<int>"))

    def alike(self, x: Column, y: Column) -> Column:
        n = F.sum(F.abs(x * y))
        return F.when(n > 0, F.sum(x * y) / n).otherwise(0.0)

    def pack(self, a: Column) -> Column:
        return V.pack_trits(F.transform(a, lambda x: x.cast("int")))

    def unpack(self, blob: Column) -> Column:
        return V.unpack_trits(blob, F.lit(self.dim))


class Digest(Ternary):
    """Ternary vectors of 32 elements whose symbols are digits of a digest, the same in every engine with md5."""

    name = "digest"

    def __init__(self, dim: int = 32, deadband: float = 0.0) -> None:
        super().__init__(dim, deadband)
        self.salts = -(-dim // 32)

    def symbol(self, text: Column) -> Column:
        return V.text_hv(text, self.salts)

    seed = symbol


_KINDS: dict[str, tuple[Callable[..., Kernel], int]] = {"real": (Real, V.REAL_DIM), "ternary": (Ternary, V.TERNARY_DIM), "digest": (Digest, 32)}


def register(name: str, kind: Callable[..., Kernel], dim: int) -> None:
    """Add a kernel under a name with its default number of dimensions."""
    _KINDS[name] = kind, dim


def kernel(name: str, dim: int | None = None, **options) -> Kernel:
    """The kernel of this name; ``dim`` is the kind's default if absent."""
    if name not in _KINDS:
        raise ValueError(f"unknown kernel {name}")
    kind, default = _KINDS[name]
    return kind(dim or default, **options)

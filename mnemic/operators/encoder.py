"""Scalar encoder: min-max scaling and random projection of parameter columns to hypervectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from mnemic.functions.vectors import random_basis


class ScalarEncoder:
    """Fit on a table with one double column per parameter.

    A projection of a scaled value x along parameter p is x * (embedding_p . basis); the product of the
    parameters' embeddings with the basis is formed once (parameters x dimensions numbers) and becomes
    literals of the plan, so encoding is a projection without a join.
    """

    def __init__(self, params: list[str], dim: int, embed_dim: int = 64, seed: int = 0, kind: str = "real", deadband: float = 0.0) -> None:
        if not params:
            raise ValueError("a scalar encoder needs parameters")
        if kind not in ("real", "ternary"):
            raise ValueError(f"unknown kernel {kind}")
        self.params, self.dim, self.kind, self.deadband = list(params), dim, kind, deadband
        basis = random_basis(embed_dim, dim, seed)
        embeddings = np.random.default_rng(seed + 1).standard_normal((len(params), embed_dim)) * 0.1
        self.projection = embeddings @ basis
        self.bounds: dict[str, tuple[float, float]] | None = None

    def fit(self, df: DataFrame) -> ScalarEncoder:
        missing = [p for p in self.params if p not in df.columns]
        if missing:
            raise ValueError(f"missing columns {missing}")
        aggs = []
        for p in self.params:
            x = F.when(~F.isnan(F.col(p).cast("double")) & (F.abs(F.col(p).cast("double")) != float("inf")), F.col(p).cast("double"))
            aggs += [F.min(x).alias(f"lo_{p}"), F.max(x).alias(f"hi_{p}")]
        r = df.agg(*aggs).first()
        self.bounds = {p: (r[f"lo_{p}"] or 0.0, r[f"hi_{p}"] or 0.0) for p in self.params}
        return self

    def scaled(self, param: str) -> Column:
        """2 * clip((x - min) / (max - min + 1e-8)) - 1; what is not finite counts as the midpoint."""
        if self.bounds is None:
            raise RuntimeError("the encoder is not fitted")
        lo, hi = self.bounds[param]
        x = F.col(param).cast("double")
        x = F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), (lo + hi) / 2).otherwise(x)
        return 2 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - lo) / (hi - lo + 1e-8))) - 1

    def encode(self, param: str) -> Column:
        """Vector of one parameter: tanh of the projection, or its sign with deadband."""
        row = self.projection[self.params.index(param)]
        x = self.scaled(param)
        p = F.transform(F.array(*[F.lit(float(v)) for v in row]), lambda b: x * b)
        if self.kind == "real":
            return F.transform(p, F.tanh)
        return F.transform(p, lambda v: F.when(F.abs(v) <= self.deadband, 0).otherwise(F.signum(v).cast("int")))

    def long(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, param, hv) of every row and parameter."""
        return df.select(*keys, F.inline(F.array(*[F.struct(F.lit(p).alias("param"), self.encode(p).alias("hv")) for p in self.params])))

    def grouped(self, groups: dict[str, list[str]]) -> Column:
        """Real vector of a row: unit bundle of the groups' unit bundles. Parameters in no group are left
        out, and one in two groups counts twice. Rows go through numpy in Arrow batches: as expressions the
        nested unit lengths would be evaluated once per element."""
        used = [p for p in self.params if any(p in g for g in groups.values())]
        rows = [self.projection[self.params.index(p)] for p in used]
        places = [[used.index(p) for p in g] for g in groups.values()]

        @F.pandas_udf(ArrayType(DoubleType()))
        def encode(*scaled: pd.Series) -> pd.Series:
            x = np.tanh(np.stack([s.to_numpy()[:, None] * r[None, :] for s, r in zip(scaled, rows, strict=True)], 1))
            parts = sum(_unit(x[:, g].sum(1)) for g in places)
            return pd.Series(list(_unit(parts)))

        return encode(*[self.scaled(p) for p in used])


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n == 0, 1.0, n)


def ste(x: np.ndarray, deadband: float) -> tuple[np.ndarray, np.ndarray]:
    """Sign with deadband, and the straight-through gradient: 1 where |x| is at most 1."""
    return np.where(np.abs(x) <= deadband, 0.0, np.sign(x)), (np.abs(x) <= 1).astype(float)

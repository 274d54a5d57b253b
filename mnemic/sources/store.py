"""Snapshots of the store as versioned Parquet, text sources, compact copies, synthetic clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemic import schemas
from mnemic.sources import crypto

#: Columns that are encrypted at rest.
SECRET = {"entities": ("canonical", "description"), "aliases": ("surface",), "documents": ("anchor", "text"), "edges": ("source",)}


class Store:
    """Tables of a graph memory; ``path`` names a folder of versions, or is None for a store in memory."""

    def __init__(self, spark: SparkSession, path: str | None = None, version: int | None = None, key: str | None = None) -> None:
        """``key``: what people wrote (SECRET columns) is encrypted at rest with it and decrypted on reading."""
        self.spark, self.path, self.key = spark, path, key
        self.version = version if version is not None else (self._latest() if path else 0)
        self.tables: dict[str, DataFrame] = {}
        for t in schemas.TABLES:
            at = f"{path}/v{self.version:06d}/{t}"
            self.tables[t] = self._read(at, t) if path and self._exists(at) else schemas.empty(spark, t)

    def _read(self, at: str, table: str) -> DataFrame:
        df = self.spark.read.option("mergeSchema", "true").parquet(at)
        if self.key:
            df = crypto.decrypt(df, [c for c in SECRET.get(table, ()) if dict(df.dtypes).get(c) == "binary"], self.key)
        return schemas.conform(df, table)

    def _fs(self, at: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(at)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, at: str) -> bool:
        fs, p = self._fs(at)
        return fs.exists(p)

    def _latest(self) -> int:
        fs, p = self._fs(self.path)
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return max((int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit()), default=0)

    def __getitem__(self, table: str) -> DataFrame:
        return self.tables[table]

    def put(self, table: str, df: DataFrame) -> Store:
        self.tables[table] = schemas.conform(df, table)
        return self

    def commit(self) -> int:
        """Write all tables as the next version; readers of earlier versions are not disturbed."""
        if not self.path:
            raise RuntimeError("a store in memory has no versions")
        nxt = self.version + 1
        for t, df in self.tables.items():
            out = crypto.encrypt(df, list(SECRET.get(t, ())), self.key) if self.key else df
            out.write.parquet(f"{self.path}/v{nxt:06d}/{t}")
        self.version = nxt
        self.tables = {t: self._read(f"{self.path}/v{nxt:06d}/{t}", t) for t in schemas.TABLES}
        return nxt

    def counts(self) -> dict[str, int]:
        return {t: df.count() for t, df in self.tables.items()}

    def export(self, path: str) -> None:
        """A compact copy: one file per table."""
        for t, df in self.tables.items():
            df.coalesce(1).write.mode("overwrite").parquet(f"{path}/{t}")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(anchor, text): one document per UTF-8 file, named by the file."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("anchor"), F.col("value").alias("text"))


def text_value(spark: SparkSession, text: str, anchor: str) -> DataFrame:
    return spark.createDataFrame([(anchor, text)], "anchor string, text string")


def synthetic_clusters(spark: SparkSession, n: int, clusters: int, dim: int, seed: int = 0, noise: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """(entities (id, cluster, hv), edges (id, head_id, tail_id, relation, weight)): members around random
    centres, a ring within each cluster, and its first member as hub. Rows are generated where they are."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            hv = []
            for i in df["id"]:
                centre = np.random.default_rng([seed, int(i) % clusters]).standard_normal(dim)
                v = centre + noise * np.random.default_rng([seed, clusters, int(i)]).standard_normal(dim)
                hv.append((v / np.linalg.norm(v)).tolist())
            yield pd.DataFrame({"id": df["id"], "cluster": df["id"] % clusters, "hv": hv})

    ids = spark.range(n)
    entities = ids.mapInPandas(rows, "id long, cluster long, hv array<double>")
    nxt = F.when(F.col("id") + clusters < n, F.col("id") + clusters).otherwise(F.pmod("id", F.lit(clusters)))
    ring = ids.select(F.col("id").alias("head_id"), nxt.alias("tail_id"), F.lit("ring").alias("relation"), F.lit(1.0).alias("weight"))
    hub = ids.filter(F.col("id") >= clusters).select(F.pmod("id", F.lit(clusters)).alias("head_id"), F.col("id").alias("tail_id"), F.lit("hub").alias("relation"), F.lit(0.5).alias("weight"))
    edges = ring.union(hub).filter("head_id <> tail_id").withColumn("id", F.xxhash64("head_id", "tail_id", "relation"))
    return entities, edges.select("id", "head_id", "tail_id", "relation", "weight")


def synthetic_scalars(spark: SparkSession, per_class: int = 24, seed: int = 0) -> DataFrame:
    """(sample_id, p0..p3, label): two Gaussian classes of four parameters."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(m, 1.0, (per_class, 4)) for m in (0.0, 2.0)])
    return spark.createDataFrame(pd.DataFrame({"sample_id": np.arange(len(x)), **{f"p{i}": x[:, i] for i in range(4)}, "label": np.repeat([0, 1], per_class)}))

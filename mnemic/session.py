"""Session helpers: table reading, the shared folder, and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Bytes of a table (by the plan's estimate) up to which it may be redistributed to occupy all cores.
SPREAD_BYTES = 4 << 30


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data directory (a Parquet file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is used, but only on a local master: on a cluster a
    machine-local folder would not be visible to all executors, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="mnemic-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


def materialize(df: DataFrame, name: str = "step", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return a scan of it.

    This cuts lineage without keeping blocks on executors: a lost executor costs nothing but the tasks
    it was running. Column pruning and filter pushdown work on the returned scan. What an application wrote is
    deleted when it ends, or before by ``release``.
    """
    spark = df.sparkSession
    path = f"{_workspace(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _workspace(spark: SparkSession) -> str:
    """The application's folder within the shared one, marked for deletion at the application's end."""
    sc = spark.sparkContext
    path = f"{shared_dir(spark)}/mnemic/{sc.applicationId}"
    if getattr(sc, "_mnemic_workspace", None) != path:
        fs, at = _hadoop(spark, path)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        sc._mnemic_workspace = path
    return path


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def release(spark: SparkSession) -> None:
    """Delete everything the application materialized so far; results that were not read yet are lost."""
    fs, at = _hadoop(spark, _workspace(spark))
    for f in fs.listStatus(at):
        fs.delete(f.getPath(), True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least one partition per core, for costly work per row.

    Only a table of fewer splits than there are cores and of at most SPREAD_BYTES (one small file, say) is
    redistributed; others are returned as they are, so at scale this adds no shuffle. To be used on scans, before any
    join or aggregate.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(n) if size <= SPREAD_BYTES and df.rdd.getNumPartitions() < n else df


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application: it is zipped and served by the
    driver, so it need not be installed on the machines of a cluster."""
    sc = spark.sparkContext
    if getattr(sc, "_mnemic_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="mnemic-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/mnemic.zip", "w") as z:
        for at, _, files in os.walk(package):
            for f in sorted(files):
                if f.endswith(".py"):
                    z.write(os.path.join(at, f), os.path.join("mnemic", os.path.relpath(os.path.join(at, f), package)))
    sc.addPyFile(f"{folder}/mnemic.zip")
    sc._mnemic_shipped = True

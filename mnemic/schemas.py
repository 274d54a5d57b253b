"""Schemas of the store's tables and the defaults of their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

TABLES = {
    "entities": "id long, canonical string, type string, description string, hv array<double>, hv_kernel string, created_at double, layer int",
    "aliases": "id long, entity_id long, surface string, created_at double",
    "edges": "id long, head_id long, tail_id long, relation string, weight double, source string, created_at double, last_used double, source_type string, confidence double, quarantined boolean, revised_at double, provenance_class string, charge double",
    "documents": "doc_id long, anchor string, text string, created_at double",
    "hierarchy": "id long, parent_id long, child_id long, layer int, created_at double",
}

# What a missing value of an edge column reads as.
EDGE_DEFAULTS = {"weight": 1.0, "source": "", "source_type": "inference", "confidence": 0.5, "quarantined": False, "provenance_class": "real", "charge": 0.0}
# Precedence and default confidence of source types, for unknown ones, and of demoted beliefs.
PRECEDENCE = {"operator": 3, "document": 2, "inference": 1, "model": 0}
CONFIDENCE = {"operator": 0.95, "document": 0.80, "inference": 0.50, "model": 0.20}
UNKNOWN_PRECEDENCE, UNKNOWN_CONFIDENCE, DEMOTED_CONFIDENCE = 1, 0.5, 0.05
RETRIEVAL_FLOOR, HYSTERESIS = 0.35, 0.10
MAX_WEIGHT = 10.0


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], StructType.fromDDL(TABLES[table]))


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table with all its columns: missing ones are added with their default (null where there is none),
    nulls of columns with a default are filled. A NaN is a missing number. Extra columns are left out."""
    out = []
    for f in StructType.fromDDL(TABLES[table]):
        default = EDGE_DEFAULTS.get(f.name) if table == "edges" else None
        col = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if f.dataType == DoubleType() and f.name in df.columns:
            col = F.when(~F.isnan(col), col)
        out.append((F.coalesce(col, F.lit(default)) if default is not None else col).alias(f.name))
    return df.select(*out)

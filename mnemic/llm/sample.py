"""A bounded, repeatable sample of texts for fitting a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PARTS = 1 << 30


def texts(df: DataFrame, key: str, text: str, limit: int) -> list[str]:
    """At most ``limit`` non-empty texts: those whose hashed keys are smallest.

    The rows are first thinned by a threshold on the hash that leaves about ``limit`` of them, so that no
    more than that is sent to the driver however many partitions there are.
    """
    live = df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("k is not null and t <> ''")
    place = F.pmod(F.xxhash64("k"), F.lit(_PARTS))
    n = live.count()
    if n > limit:
        live = live.filter(place < int(min(1.0, 1.2 * limit / n) * _PARTS))
    return [r["t"] for r in live.orderBy(place, "k").limit(limit).collect()]

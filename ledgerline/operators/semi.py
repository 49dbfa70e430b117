"""'Has any matching row' flag per key, kept on every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def semi_flag(df: DataFrame, keys: Sequence[str], cond: Column, name: str) -> DataFrame:
    """Add ``name`` = 1 when any row of the same key satisfies ``cond``, else NULL.

    The flag is a grouped aggregate (partial on the map side, one row per key) joined back on
    the key: a key with many rows is never gathered into a single window partition, and AQE
    splits a skewed key on the big side of the join.
    """
    keys = list(keys)
    flags = (df.where(cond).select(*keys).distinct().withColumn(name, F.lit(1)))
    return df.join(flags, on=keys, how="left")

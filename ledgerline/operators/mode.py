"""Modal value per group (most frequent; ties go to the smaller value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mode_per_key(df: DataFrame, keys: Sequence[str], value: str, name: str | None = None,
                 count_name: str | None = None) -> DataFrame:
    """Two grouped aggregates, both with map-side partial aggregation: count per
    (key, value), then keep the value with the highest count, the smaller value on ties.
    """
    name = name or f"modal_{value}"
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    best = F.max_by(F.struct(F.col(value).alias("v"), F.col("_n").alias("n")),
                    F.struct(F.col("_n"), -F.col(value)))
    out = counted.groupBy(*keys).agg(best.alias("_m"))
    cols = [*keys, F.col("_m.v").alias(name)]
    if count_name:
        cols.append(F.col("_m.n").alias(count_name))
    return out.select(*cols)

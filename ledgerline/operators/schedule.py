"""Expansion of one row into its n instalments (the number-table join ``n < num_periods``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand_periods(df: DataFrame, n_col: str, max_periods: int | None = None,
                   name: str = "n") -> DataFrame:
    """Row × n for n in 0 .. n_col - 1. A row of more than ``max_periods`` (if given) is an error, never cut.

    ``explode(sequence(...))`` runs inside the row's own task (no join, no shuffle); rows with
    no period are dropped first because ``sequence(0, -1)`` is ``[0, -1]``.
    """
    count = F.col(n_col)
    if max_periods is not None:
        too_many = F.raise_error(F.concat(F.lit(f"more than {max_periods} periods: "), count.cast("string")))
        count = F.when(count > max_periods, too_many.cast("int")).otherwise(count)
    return (df.where(count > 0)
              .withColumn(name, F.explode(F.sequence(F.lit(0), (count - 1).cast("int")))))

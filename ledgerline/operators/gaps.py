"""Gaps between consecutive dates per key (lag + datediff)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import RANGE_ROWS, previous


def gaps(df: DataFrame, keys: Sequence[str], date_col: str, order: Sequence[str] = (),
         prior_name: str = "prior_date", gap_name: str = "gap_days", balanced: bool = True,
         range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add the previous ``date_col`` of the same key and the day gap to it.

    ``order`` adds tie-break columns after the date so equal dates get a stable order.
    ``balanced`` (default) uses the scan in ranges of ``operators.ordered``: a key with more than ``range_rows`` rows is
    spread over several tasks, also where all its rows lie on one date.
    """
    sort = [F.col(date_col), *[F.col(c) for c in order]]
    if balanced:
        out = previous(df, keys, sort, date_col, prior_name, range_rows, ties=[F.xxhash64(*df.columns)])
    else:
        w = Window.partitionBy(*keys).orderBy(*sort)
        out = df.withColumn(prior_name, F.lag(date_col).over(w))
    return out.withColumn(gap_name, F.datediff(F.col(date_col), F.col(prior_name)))

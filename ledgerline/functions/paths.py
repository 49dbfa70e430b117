"""Delimited-path helpers (URL paths, category paths, 'Type:detail' codes)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_leading(col: Column, ch: str = "/") -> Column:
    """TRIM(LEADING ch FROM s): removes every leading ``ch``."""
    return F.ltrim(col, F.lit(ch))


def path_part(col: Column, n: int, sep: str = "/") -> Column:
    """Piece ``n`` (1-based) of a path, SUBSTRING_INDEX style: with fewer than n pieces the
    last piece is returned."""
    return F.substring_index(F.substring_index(col, sep, n), sep, -1)


def prefix_before(col: Column, ch: str) -> Column:
    """``substring(s, 1, locate(ch, s) - 1)``: text before the first ``ch``; '' when absent."""
    pos = F.locate(ch, col)
    return F.when(pos > 0, F.substring_index(col, ch, 1)).otherwise(F.lit(""))

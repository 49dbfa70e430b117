"""Latest (or best) row per key, and running sequence numbers per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import wall_micros
from .ordered import RANGE_ROWS, sequence


def asc_key(col: Column, kind: str = "number") -> Column:
    """Turn an ascending sort key into one whose *maximum* is wanted.

    ``kind`` is ``number``, ``date`` or ``timestamp``.
    """
    if kind == "date":
        return -F.unix_date(col)
    if kind == "timestamp":
        return -wall_micros(col)
    return -col


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                   payload: Sequence[str] | None = None) -> DataFrame:
    """One row per ``keys``: the row whose ``order`` tuple is greatest.

    Built as ``max_by(struct(payload), struct(order))`` in a grouped aggregate rather than a
    ``row_number`` window: the aggregate runs a partial (map-side) step, so a key holding a
    large share of the rows is reduced to one row per input partition before the shuffle and
    never lands whole in one task. Give a unique column last in ``order`` so ties are stable
    (use :func:`asc_key` for ascending keys).
    """
    payload = list(payload) if payload is not None else [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*[F.col(c) for c in payload]), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("_best." + c).alias(c) for c in payload])


def sequence_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                     name: str = "seq", balanced: bool = True, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` added as ``name``.

    ``balanced`` (default) uses the scan in ranges of ``operators.ordered``: a key with more than ``range_rows`` rows
    is split across tasks; ``order`` must then be unique within a key.
    """
    if balanced:
        return sequence(df, keys, order, name, range_rows)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w))

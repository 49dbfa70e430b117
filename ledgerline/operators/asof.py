"""As-of lookup in both directions: the nearest right-side time at/before and after each left row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import RANGE_ROWS, fill_both


def asof_prev_next(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str,
                   right_time: str, prev_name: str = "prev", next_name: str = "next",
                   balanced: bool = True, range_rows: int = RANGE_ROWS) -> DataFrame:
    """For every ``left`` row add ``prev`` = max(right_time <= left_time) and
    ``next`` = min(right_time > left_time) among right rows with equal ``on`` keys.

    Instead of joining every left row to every right row of its key (which emits all pairs of
    a key), both sides are unioned into one time line per key and scanned once by a window:
    right rows sort before left rows at the same instant, so "at or before" includes them and
    "after" excludes them. Cost is one shuffle by key and one sort, O(n log n), whatever the
    number of right rows per key. Right times are de-duplicated first. Every left row stays; one with
    a NULL key or time has no neighbour.
    """
    on = list(on)
    lcols = left.columns
    lt, rt = left.schema[left_time].dataType, right.schema[right_time].dataType
    tt = lt if lt == rt else "timestamp_ntz"  # wall-clock: no session time zone in the order
    r = (right.select(*[F.col(k) for k in on], F.col(right_time).cast(tt).alias("_t"))
              .dropna(subset=[*on, "_t"]).distinct()
              .select(*on, "_t", F.lit(0).alias("_side"), F.col("_t").cast(rt).alias("_rt"),
                      *[F.lit(None).cast(left.schema[c].dataType).alias(c)
                        for c in lcols if c not in on]))
    l = left.select(*on, F.col(left_time).cast(tt).alias("_t"), F.lit(1).alias("_side"),
                    F.lit(None).cast(rt).alias("_rt"),
                    *[c for c in lcols if c not in on])
    both = r.unionByName(l)
    if balanced:
        # One pass in ranges (operators.ordered): a key with more than ``range_rows`` rows is split across tasks at points
        # drawn from its times; the nearest value crosses the borders through a summary.
        # Right rows sort before left rows at the same instant ("at or before" includes them);
        # in the reversed order left rows come first ("after" stays strict).
        out = fill_both(both, on, [F.col("_t"), F.col("_side")], [F.col("_t").desc(), F.col("_side").desc()],
                        "_rt", prev_name, next_name, range_rows, ties=[F.xxhash64(*both.columns)])
        return _known_times(out.where(F.col("_side") == 1), prev_name, next_name).select(*lcols, prev_name, next_name)
    w_prev = (Window.partitionBy(*on).orderBy("_t", "_side")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # "after": scan the same time line backwards with a running frame. A frame reaching to the end
    # of the partition would make Spark buffer the whole key; running frames stream.
    # At equal instants left rows come first in this backward scan, so "after" stays strict.
    w_next = (Window.partitionBy(*on).orderBy(F.col("_t").desc(), F.col("_side").desc())
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = (both.withColumn(prev_name, F.last("_rt", ignorenulls=True).over(w_prev))
               .withColumn(next_name, F.last("_rt", ignorenulls=True).over(w_next))
               .where(F.col("_side") == 1))
    return _known_times(out, prev_name, next_name).select(*lcols, prev_name, next_name)


def _known_times(out: DataFrame, *names: str) -> DataFrame:
    """No neighbour for a left row without a time: comparisons with NULL match nothing."""
    return out.withColumns({n: F.when(F.col("_t").isNotNull(), F.col(n)) for n in names})

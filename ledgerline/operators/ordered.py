"""Ordered scans per key that stay balanced when one key holds a large share of the rows.

A window ``partitionBy(key).orderBy(t)`` sends every row of a key to one task. Here the rows of each heavy key are cut into
ranges of about equal numbers of rows, at split points drawn from the data itself, and the window runs per (key, range). The
values that cross a range's border (running count, previous row, last non-null value) come from a summary with one row per
(heavy key, range), scanned per key in range order and joined back.

Split points: keys with more than ``rows`` rows are heavy, at most the ``MAX_KEYS`` largest (any other key then holds less than a
thousandth of all rows, and its whole window is no larger than an ordinary task). Of each heavy key a sketch of about
``PER_RANGE`` rows a range is kept, chosen by a hash of the ordering values, sorted, and every ``PER_RANGE``-th of them is a
split point. Both tables are bounded by these constants whatever the input, so they are broadcast; where no key is
heavy they are empty, adaptive execution drops their joins, and the plan is the plain window.

Split points depend only on row values and exact counts, so every recomputation (retries, lost executors) assigns rows the same way.
Rows that are equal in all ordering values (and in ``ties``) share a range. Everything is built-in Spark SQL; nothing is
collected by a caller. ``order`` holds plain ascending expressions. Rows with a NULL key or a NULL ordering value stay: NULL is
a key like any other and sorts first, as in a window over the whole key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_ROWS = 1 << 20     # rows of a range, and the most a key may have and stay whole
MAX_KEYS = 1024          # heavy keys
MAX_RANGES = 256         # ranges of one key
PER_RANGE = 16           # sketch entries of a range

_RANGE, _SPLITS = "_range", "_splits"


def _pos(order: Sequence[Column]) -> Column:
    return F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])


def _key_names(keys: Sequence[str]) -> list[str]:
    return [f"_key{i}" for i in range(len(keys))]


def _beside(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """``df`` joined to a bounded table keyed by ``_key0 ...``; NULL keys are equal, as they are for a window."""
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, _key_names(keys))]
    return df.join(F.broadcast(small), same, how).drop(*_key_names(keys))


def split_points(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rows: int = RANGE_ROWS) -> DataFrame:
    """One row per heavy key: ``_key0 ...`` and ``_splits``, the ascending ordering values at which its ranges begin."""
    names = _key_names(keys)
    keyed = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], _pos(order).alias("_pos"))
    heavy = (keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows)
                  .orderBy(F.col("_n").desc(), *names).limit(MAX_KEYS))
    heavy = heavy.withColumn("_ranges", F.least(F.lit(MAX_RANGES), F.ceil(F.col("_n") / rows)).cast("int"))
    heavy = heavy.withColumnsRenamed({n: f"{n}_" for n in names})
    one_in = F.greatest(F.lit(1), F.floor(F.col("_n") / (F.col("_ranges") * PER_RANGE))).cast("long")
    sketch = (keyed.join(F.broadcast(heavy), [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names])
                   .where(F.pmod(F.xxhash64("_pos"), one_in) == 0)
                   .groupBy(*names).agg(F.array_sort(F.collect_list("_pos")).alias("_s"), F.first("_ranges").alias("_ranges")))
    at = lambda i: F.element_at("_s", (F.floor(i * F.size("_s") / F.col("_ranges")) + 1).cast("int"))
    inner = F.when(F.col("_ranges") > 1, F.sequence(F.lit(1), F.col("_ranges") - 1))
    return sketch.select(*names, F.array_distinct(F.transform(inner, at)).alias(_SPLITS))


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rows: int = RANGE_ROWS,
              ties: Sequence[Column] = ()) -> DataFrame:
    """``df`` plus ``_range``: NULL for keys that stay whole, else the number of the row's range, which never decreases
    along ``order``. ``ties`` are further columns that may part rows of equal order."""
    order = [*order, *ties]
    split = _beside(df, split_points(df, keys, order, rows), keys, "left")
    steps = F.array(*[F.lit(MAX_RANGES >> i) for i in range(1, MAX_RANGES.bit_length())])
    pos = _pos(order)
    found = F.reduce(steps, F.lit(0), lambda at, step: F.when(F.get(F.col(_SPLITS), at + step - 1) <= pos, at + step).otherwise(at))
    return split.withColumn(_RANGE, F.when(F.col(_SPLITS).isNotNull(), found)).drop(_SPLITS)


def _earlier(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)


def _later(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(F.col(_RANGE).desc()).rowsBetween(Window.unboundedPreceding, -1)


def _summary(base: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """One row per (heavy key, range), aggregated from the input rows with a map-side step."""
    return base.where(F.col(_RANGE).isNotNull()).groupBy(*keys, _RANGE).agg(*aggregates)


def _carried(local: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``local`` with the carries of its (key, range); rows of keys that stay whole have none."""
    names = [*keys, _RANGE]
    return _beside(local, summary.withColumnsRenamed(dict(zip(names, _key_names(names)))), names, "left").drop(_RANGE)


def sequence(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, rows: int = RANGE_ROWS) -> DataFrame:
    """``row_number() over (partition by keys order by order)``; ``order`` unique within a key (or equal rows alike)."""
    keys = list(keys)
    base = in_ranges(df, keys, order, rows)
    local = base.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, _RANGE).orderBy(*order)))
    summary = _summary(base, keys, F.count(F.lit(1)).alias("_n"))
    summary = summary.select(*keys, _RANGE, F.sum("_n").over(_earlier(keys)).alias("_before"))
    out = _carried(local, summary, keys)
    return out.withColumn(name, F.col("_rn") + F.coalesce(F.col("_before"), F.lit(0))).drop("_rn", "_before")


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, name: str, rows: int = RANGE_ROWS,
             ties: Sequence[Column] = ()) -> DataFrame:
    """``lag(value) over (partition by keys order by order)``."""
    keys = list(keys)
    base = in_ranges(df, keys, order, rows, ties)
    w = Window.partitionBy(*keys, _RANGE).orderBy(*order)
    local = base.withColumn("_lag", F.lag(value).over(w)).withColumn("_rn", F.row_number().over(w))
    summary = _summary(base, keys, F.max_by(F.col(value), _pos(order)).alias("_lastv"))
    summary = summary.select(*keys, _RANGE, F.lag("_lastv").over(Window.partitionBy(*keys).orderBy(_RANGE)).alias("_carry"))
    out = _carried(local, summary, keys)
    return out.withColumn(name, F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_lag"))).drop("_lag", "_rn", "_carry")


def fill_both(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rev_order: Sequence[Column],
              value: str, prev_name: str, next_name: str, rows: int = RANGE_ROWS, ties: Sequence[Column] = ()) -> DataFrame:
    """Forward fill (last non-null at or before the row along ``order``) and backward fill (first
    non-null at or after the row, i.e. last non-null along ``rev_order``) in one pass.

    ``rev_order`` is the exact reverse of ``order`` (descending, so NULL values come last). One partitioning by
    (key, range) serves both running windows and one summary per (heavy key, range) serves both carries. Running
    frames only: a frame to the end of the partition would make Spark buffer it.
    """
    keys = list(keys)
    base = in_ranges(df, keys, order, rows, ties)
    part = Window.partitionBy(*keys, _RANGE)
    fwd = part.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bwd = part.orderBy(*rev_order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = (base.withColumn("_ff", F.last(value, ignorenulls=True).over(fwd))
                 .withColumn("_bf", F.last(value, ignorenulls=True).over(bwd)))
    present = F.col(value).isNotNull()
    summary = _summary(base, keys, F.max_by(F.col(value), F.when(present, _pos(order))).alias("_lastv"),
                       F.min_by(F.col(value), F.when(present, _pos(order))).alias("_firstv"))
    summary = summary.select(*keys, _RANGE, F.last("_lastv", ignorenulls=True).over(_earlier(keys)).alias("_pcarry"),
                             F.last("_firstv", ignorenulls=True).over(_later(keys)).alias("_ncarry"))
    out = _carried(local, summary, keys)
    return out.withColumns({prev_name: F.coalesce(F.col("_ff"), F.col("_pcarry")),
                            next_name: F.coalesce(F.col("_bf"), F.col("_ncarry"))}).drop("_ff", "_bf", "_pcarry", "_ncarry")

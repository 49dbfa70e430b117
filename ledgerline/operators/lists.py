"""Ordered lists of very large keys: text lists merged in two levels, and the same lists as rows.

``functions.text_list`` gathers a key's values in one aggregate buffer. Here equal values are counted first (with a map-side step, so
a value that holds a third of the rows is one row), the distinct values of a heavy key are cut into ranges at points drawn from the data
(``operators.ordered``), each range is sorted and joined in its own task, and a key's text is put together from at most
``ordered.MAX_RANGES`` parts. What a task holds besides the text itself follows the range and not the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import RANGE_ROWS, in_ranges, sequence


def text_list_per_key(df: DataFrame, keys: Sequence[str], value: str, name: str = "list", sep: str = ",", distinct: bool = True,
                      range_rows: int = RANGE_ROWS) -> DataFrame:
    """``(keys, name)``: the ascending values of each key, NULLs skipped, joined by ``sep``. Keys without a value have no row.

    The text of a key is one value of one row, which the engine bounds at 2 GB; :func:`list_rows` has no such bound.
    """
    keys = list(keys)
    values = df.select(*keys, F.col(value).cast("string").alias("_v")).where(F.col("_v").isNotNull())
    counted = values.groupBy(*keys, "_v").agg(F.count(F.lit(1)).cast("int").alias("_times"))
    ranged = in_ranges(counted, keys, [F.col("_v")], range_rows)
    one = lambda x: x["_v"] if distinct else F.concat(x["_v"], F.repeat(F.concat(F.lit(sep), x["_v"]), x["_times"] - 1))
    joined = lambda array, item: F.array_join(F.transform(F.array_sort(array), item), sep)
    parts = ranged.groupBy(*keys, "_range").agg(joined(F.collect_list(F.struct("_v", "_times")), one).alias("_part"))
    return parts.groupBy(*keys).agg(joined(F.collect_list(F.struct("_range", "_part")), lambda x: x["_part"]).alias(name))


def list_rows(df: DataFrame, keys: Sequence[str], value: str, name: str = "position", range_rows: int = RANGE_ROWS) -> DataFrame:
    """The list as rows: ``keys``, ``value`` and its place from 1 in ascending order, NULLs skipped, repeated values each with a place."""
    keys = list(keys)
    return sequence(df.select(*keys, value).where(F.col(value).isNotNull()), keys, [F.col(value)], name, range_rows)

"""Aggregate helpers: conditional aggregates and ordered text lists (group_concat)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sum_if(cond: Column, value: Column) -> Column:
    """``sum(case when cond then value end)``: NULL when no row matches."""
    return F.sum(F.when(cond, value))


def min_if(cond: Column, value: Column) -> Column:
    return F.min(F.when(cond, value))


def max_if(cond: Column, value: Column) -> Column:
    return F.max(F.when(cond, value))


def any_if(cond: Column) -> Column:
    """``sum(distinct case when cond then 1 end)``: 1 when any row matches, else NULL."""
    return F.max(F.when(cond, F.lit(1)))


def text_list(col: Column, sep: str = ",", distinct: bool = True, order_by: Column | None = None,
              empty_as_null: bool = True) -> Column:
    """group_concat: NULLs skipped, sorted ascending (by ``order_by`` when given, else by the
    text), NULL (not '') when nothing is left.

    The values of a key end in one aggregate buffer of one task (``collect_set`` drops repeats before the shuffle,
    ``collect_list`` does not), so this is for keys with a moderate number of values. For any number use
    ``operators.text_list_per_key`` or, as rows, ``operators.list_rows``.
    """
    if order_by is not None:
        pairs = F.array_sort(F.collect_list(F.struct(order_by.alias("k"), col.alias("v"))))
        return F.nullif(F.array_join(F.transform(pairs, lambda x: x["v"]), sep), F.lit(""))
    gathered = F.collect_set(col) if distinct else F.collect_list(col)
    joined = F.array_join(F.array_sort(gathered), sep)
    if not empty_as_null:
        return F.when(F.size(gathered) > 0, joined)
    return F.nullif(joined, F.lit(""))

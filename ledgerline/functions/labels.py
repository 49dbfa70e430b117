"""Label ladders: ordered (condition, label) lists where the first true condition wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def label(cases: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """Searched CASE: first matching condition wins; ``default`` when none (NULL if None).

    Values may be Python literals or Columns.
    """
    if not cases:
        return F.lit(default)
    expr = None
    for cond, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    if default is None:
        return expr
    return expr.otherwise(default if isinstance(default, Column) else F.lit(default))


def band(col: Column, edges: Sequence[tuple[object, object, str]], default: object = None) -> Column:
    """Inclusive BETWEEN bands ``[(lo, hi, label), ...]``; first match wins."""
    return label([(col.between(lo, hi), name) for lo, hi, name in edges], default)


def flag_list(flags: dict[str, Column], sep: str = ", ") -> Column:
    """Names of the 0/1 flags that are 1, joined by ``sep``; NULL when none is set."""
    parts = [F.when(c == 1, F.lit(name)) for name, c in flags.items()]
    return F.nullif(F.concat_ws(sep, *parts), F.lit(""))

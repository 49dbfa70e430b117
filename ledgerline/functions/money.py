"""Exact cent splitting of a decimal total into n instalments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_cents(total: Column, parts: Column, n: Column | None = None) -> Column | tuple[Column, Column]:
    """Split ``total`` (decimal, cents) into ``parts`` equal floor-cent pieces; the remainder
    goes to the last piece.

    Without ``n`` returns ``(base_amount, remainder_amount)``; with ``n`` (0-based index)
    returns the amount of that instalment. Both are decimal(18,2) and sum exactly to total.
    """
    cents = F.round(total * 100, 0).cast("decimal(20,0)")
    base_cents = F.floor(total * 100 / parts).cast("decimal(20,0)")
    base = (base_cents / 100).cast("decimal(18,2)")
    remainder = ((cents - base_cents * parts) / 100).cast("decimal(18,2)")
    if n is None:
        return base, remainder
    return F.when(n + 1 == parts, base + remainder).otherwise(base).cast("decimal(18,2)")


def exact_div(num: Column, den: Column, scale: int, unit: int = 100) -> Column:
    """``num / den`` rounded half-up to ``scale`` decimals, computed exactly.

    ``num`` and ``den`` are decimals with at most ``log10(unit)`` decimals (cents by default), so
    ``num * unit`` and ``den * unit`` are whole numbers and the quotient is an integer division.
    This is the database's decimal division (dividend scale + 4, half-up); NULL when ``den`` is 0.
    """
    n = (num * unit).cast("bigint")
    d = (den * unit).cast("bigint")
    k = 10 ** scale
    q = idiv(F.abs(n) * (2 * k) + F.abs(d), F.abs(d) * 2)
    signed = F.when((n < 0) != (d < 0), -q).otherwise(q)
    return F.when(d != 0, (signed.cast("decimal(38,0)") / k).cast(f"decimal(28,{scale})"))


def idiv(a: Column, b: Column) -> Column:
    """Exact floor division of non-negative whole numbers (no floating point, no rounding)."""
    a = a.cast("decimal(38,0)")
    b = b.cast("decimal(38,0)")
    return ((a - F.pmod(a, b)) / b).cast("decimal(38,0)")

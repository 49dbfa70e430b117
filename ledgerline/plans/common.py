"""Shared pieces of the reports: parameters, employer filter, normalised status text."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import domain
from ..sources.adapters import ADAPTERS
from ..sources.shared import bucket_count, shared_view

# Fixed "today" of the checked reports; every report takes it as a parameter instead of
# reading the clock.
AS_OF = dt.date(2001, 6, 30)
TZ = "America/Chicago"


def d(spark, t, name: str) -> DataFrame:
    return domain(spark, t, name)


def view_buckets(t) -> int:
    """Buckets of the views by agreement: one number, so that they join each other without a shuffle."""
    return bucket_count(t["lineitem"], t["orders"])


def ledger_view(spark, t) -> DataFrame:
    """The ledger bucketed by agreement (sources.shared), written once for all reports that read it by agreement. The line items are
    dealt out before the ledger's texts are made of them."""
    n = view_buckets(t)
    return shared_view(t, "ledger", "agreement_id", lambda: ADAPTERS["ledger"].spark(
        spark, {"lineitem": t["lineitem"].repartition(n, "l_orderkey")}), n, dealt=True)


def for_employer(df: DataFrame, employer_id: int | None, col: str = "employer_id") -> DataFrame:
    """Rows of one employer; ``None`` keeps every employer."""
    return df if employer_id is None else df.where(F.col(col) == employer_id)


def norm(col: Column | str) -> Column:
    """Status text compared the way the source database compares it: case-insensitive and
    ignoring trailing spaces."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(F.rtrim(c))


def lit_date(value: dt.date) -> Column:
    return F.lit(value).cast("date")


def lit_ts(value: dt.datetime) -> Column:
    """Wall-clock timestamp literal (timestamp_ntz) built from its ISO text, so the session
    time zone never shifts it."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def sql_exact_div(num: str, den: str, scale: int, unit: int = 100) -> str:
    """DuckDB text of ``functions.money.exact_div`` (used by the oracle statements)."""
    n = f"CAST(({num}) * {unit} AS BIGINT)"
    dd = f"CAST(({den}) * {unit} AS BIGINT)"
    k = 10 ** scale
    return (f"CASE WHEN {dd} <> 0 THEN CAST(CAST(sign({n}) * sign({dd}) * ((abs({n}) * {2 * k} + abs({dd})) "
            f"// (abs({dd}) * 2)) AS DOUBLE) / {k} AS DECIMAL(28,{scale})) END")


def sql_months_between(start: str, end_year: int, end_month: int, end_day: int) -> str:
    """Whole months from a date ``start`` to a fixed date, database style (a month counts once its
    day is reached)."""
    return (f"CAST(({end_year} - year({start})) * 12 + ({end_month} - month({start})) "
            f"- CASE WHEN {end_day} < day({start}) THEN 1 ELSE 0 END AS BIGINT)")


def sql_months_diff(start: str, end: str) -> str:
    """Whole months between two dates, database style: truncated toward zero in both directions."""
    def fwd(a, b):
        return (f"((year({b}) - year({a})) * 12 + (month({b}) - month({a})) "
                f"- CASE WHEN day({b}) < day({a}) THEN 1 ELSE 0 END)")
    return f"CAST(CASE WHEN {end} >= {start} THEN {fwd(start, end)} ELSE -{fwd(end, start)} END AS BIGINT)"


def protect(col: Column | str, include_sensitive: bool) -> Column:
    """Personal data (e-mail, birth date) in clear only when asked for; otherwise its SHA-256
    hex digest, which still joins and groups the same way."""
    c = F.col(col) if isinstance(col, str) else col
    return c if include_sensitive else F.sha2(c.cast("string"), 256)

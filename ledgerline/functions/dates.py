"""Date helpers: whole-unit differences, weekend shift, local dates, schedule steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wall_micros(ts: Column) -> Column:
    """Microseconds of a wall-clock timestamp since 1970-01-01 00:00, whatever the session time zone."""
    day = F.unix_date(F.to_date(ts)).cast("long")
    seconds = F.extract(F.lit("SECOND"), ts) * 1_000_000
    return (day * 1440 + F.hour(ts) * 60 + F.minute(ts)) * 60_000_000 + seconds.cast("long")


def whole_units(unit: str, start: Column, end: Column) -> Column:
    """TIMESTAMPDIFF(unit, start, end): whole units, truncated toward zero."""
    return F.timestamp_diff(unit.upper(), start, end)


def shift_weekend(d: Column, timestamp: bool = False) -> Column:
    """Saturday and Sunday move forward to the next Monday (weekday(): Monday = 0).

    With ``timestamp=True`` the time of day is kept.
    """
    wd = F.weekday(d)
    if timestamp:
        return (F.when(wd == 5, d + F.expr("INTERVAL 2 DAYS"))
                 .when(wd == 6, d + F.expr("INTERVAL 1 DAYS"))
                 .otherwise(d))
    return (F.when(wd == 5, F.date_add(d, 2))
             .when(wd == 6, F.date_add(d, 1))
             .otherwise(d))


def local_date(ts: Column, tz: str) -> Column:
    """Calendar date of a UTC wall-clock timestamp in zone ``tz``."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(tz), ts))


def step_date(anchor: Column, n: Column, frequency: Column) -> Column:
    """Date of instalment ``n`` (0-based) counted from ``anchor``.

    Weekly and Bi-Weekly add 7n / 14n days, Monthly adds n months (month end clamps),
    Semi-Monthly adds n/2 months on even steps and floor(n/2) months + 15 days on odd steps.
    Always computed from the anchor, never from the previous instalment.
    """
    half = F.floor(n / 2).cast("int")
    return (F.when(frequency == "Weekly", F.date_add(anchor, (n * 7).cast("int")))
             .when(frequency == "Bi-Weekly", F.date_add(anchor, (n * 14).cast("int")))
             .when(frequency == "Monthly", F.add_months(anchor, n.cast("int")))
             .when(frequency == "Semi-Monthly",
                   F.when(n % 2 == 0, F.add_months(anchor, half))
                    .otherwise(F.date_add(F.add_months(anchor, half), 15))))


def first_of(dates: dict[str, Column], greatest: bool = False,
             sentinel: str = "9999-12-31", none_label: str = "NONE") -> tuple[Column, Column]:
    """Earliest (or latest) of several nullable dates and the name of the one that won.

    Each date is replaced by a sentinel when NULL so ``least``/``greatest`` behave the same on
    every engine; the result is NULL with reason ``none_label`` when all are NULL. Ties go to
    the first name in ``dates``.
    """
    lo = "0001-01-01" if greatest else sentinel
    fill = F.lit(lo).cast("date")
    filled = [F.coalesce(c, fill) for c in dates.values()]
    m = F.greatest(*filled) if greatest else F.least(*filled)
    value = F.when(m != fill, m)
    reason = F.when(m == fill, F.lit(none_label))
    for name, c in dates.items():
        reason = reason.when(m == c, F.lit(name))
    return value, reason

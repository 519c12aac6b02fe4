"""Date and time functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local(ts: Column, zone: str) -> Column:
    """A timestamp without zone, taken as UTC, as the clock of a zone shows it."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def market_open(at: Column, opens: int = 10, closes: int = 18) -> Column:
    """Monday to Friday, from the opening hour to before the closing one, in local time."""
    return (F.weekday(at) < 5) & (F.hour(at) >= opens) & (F.hour(at) < closes)


def days_left(day: Column, end: Column) -> Column:
    return F.date_diff(end, day)


def years_left(day: Column, end: Column) -> Column:
    """Calendar days over 365."""
    return days_left(day, end) / F.lit(365.0)


def stale(seen: Column, now: Column, days: int) -> Column:
    return seen < now - F.expr(f"INTERVAL {days} DAYS")


def since(today: Column, last_run: Column | None, days: int) -> Column:
    """A day before the last run, else so many days before today."""
    back = F.date_sub(today, days)
    return back if last_run is None else F.coalesce(F.date_sub(last_run, 1), back)


def slot(day: Column, hour: Column) -> Column:
    """The moment of an hour of a day, without zone."""
    return F.make_timestamp_ntz(F.year(day), F.month(day), F.dayofmonth(day), hour, F.lit(0), F.lit(0.0))


def releases(start: Column, months: int, day: int) -> Column:
    """That day of the start's month and of the months after it."""
    first = F.date_add(F.trunc(start, "month"), day - 1)
    return F.sequence(first, F.add_months(first, months - 1), F.expr("INTERVAL 1 MONTH"))

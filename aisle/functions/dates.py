"""Calendar predicates and labels over zone-less timestamps."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

Day = str | dt.date | Column


def day(value: Day | None) -> Column:
    """A date column from a literal; today when nothing is given."""
    if value is None:
        return F.current_date()
    if isinstance(value, Column):
        return value
    return F.lit(value).cast("date")


def between_days(ts: Column, start: Day, end: Day) -> Column:
    """Calendar days ``start`` to ``end``, both included; reaches the scan as a timestamp range."""
    return F.to_date(ts).between(day(start), day(end))


def trailing_months(ts: Column, as_of: Day | None, months: int) -> Column:
    """On or after the day ``months`` before ``as_of``; short months clamp to their last day."""
    return ts >= F.add_months(day(as_of), -months)


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def month_start(ts: Column) -> Column:
    return F.trunc(ts, "MM")


def next_month_start(as_of: Day | None) -> Column:
    return F.trunc(F.add_months(day(as_of), 1), "MM")


def hour_between(ts: Column, first: int, last: int) -> Column:
    """Hour of day within ``first``..``last``, both included."""
    return F.hour(ts).between(first, last)


def clock_text(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def seconds_between(earlier: Column, later: Column) -> Column:
    """Whole seconds from ``earlier`` to ``later``, truncated toward zero.

    Interval subtraction keeps zone-less timestamps zone-less, so daylight-saving changes in the
    session zone cannot shift the result.
    """
    return (later - earlier).cast("interval second").cast("bigint")


def seconds(count: int) -> Column:
    """A day-time interval literal of ``count`` seconds."""
    return F.make_dt_interval(secs=F.lit(count))

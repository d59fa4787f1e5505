"""Reporting-calendar arithmetic (DT7, DT8, U6, R26). Pure column expressions
over an explicit run date; nothing reads the wall clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["as_date", "month_start", "prev_month_start", "prev_month_end",
           "days_in_month", "days_past", "days_left"]


def as_date(d: Column | str) -> Column:
    return F.lit(d).cast("date") if isinstance(d, str) else d.cast("date")


def month_start(d: Column | str) -> Column:
    return F.trunc(as_date(d), "MM")


def prev_month_start(d: Column | str) -> Column:
    return F.add_months(month_start(d), -1)


def prev_month_end(d: Column | str) -> Column:
    return F.date_sub(month_start(d), 1)


def days_in_month(d: Column | str) -> Column:
    return F.dayofmonth(F.last_day(as_date(d)))


def days_past(d: Column | str) -> Column:
    """Days of the month elapsed before the run date (run date excluded)."""
    return F.dayofmonth(as_date(d)) - 1


def days_left(d: Column | str) -> Column:
    """Days from the run date to month end, run date included."""
    return F.datediff(F.last_day(as_date(d)), as_date(d)) + 1

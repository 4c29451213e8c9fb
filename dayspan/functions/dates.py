"""Differences between dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier).cast("bigint")


def whole_months(start: Column, stop: Column) -> Column:
    """Completed calendar months from ``start`` to ``stop``, rounded down (also below zero).

    Counts a month only once its day of month is reached, so the last day of a
    short month does not complete a month begun on a later day.
    """
    months = 12 * (F.year(stop) - F.year(start)) + (F.month(stop) - F.month(start))
    return (months - F.when(F.dayofmonth(stop) < F.dayofmonth(start), 1).otherwise(0)).cast("bigint")


def calendar_year(day: Column) -> Column:
    return F.year(day).cast("bigint")

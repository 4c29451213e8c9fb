"""Text to number, timestamp and date, and the day a timestamped response belongs to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(text: Column) -> Column:
    """Double, or null where the text is not a number."""
    return F.trim(text.cast("string")).try_cast("double")


def to_datetime(text: Column) -> Column:
    """Timestamp without zone (read as UTC), or null where the text is not one."""
    return text.cast("string").try_cast("timestamp_ntz")


def parse_mdy(text: Column) -> Column:
    """Date from ``month/day/two-digit year``; 69-99 mean 1969-1999, 00-68 mean 2000-2068.

    Spark reads every two-digit year as 20yy, hence the step back of a century.
    """
    parsed = F.try_to_timestamp(text, F.lit("M/d/yy")).cast("date")
    return F.when(F.year(parsed) >= 2069, F.add_months(parsed, -1200)).otherwise(parsed)


def clock_text(moment: Column) -> Column:
    return F.date_format(moment, "HH:mm:ss")


def assign_day(moment: Column, day_start: str = "00:00:00", day_end: str = "00:00:00") -> Column:
    """Calendar day of a response; strictly between the two clock times it is the day before.

    With the defaults no response moves. Clock times compare as HH:MM:SS text.
    """
    own_day = moment.cast("date")
    clock = clock_text(moment)
    return F.when((clock > day_start) & (clock < day_end), F.date_sub(own_day, 1)).otherwise(own_day)

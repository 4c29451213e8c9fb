"""Participant-day panel from date ranges with an optional pause."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayspan.operators.joins import full_join
from dayspan.operators.windows import study_day


def _days(first: Column, last: Column) -> Column:
    """All days of a closed range; no day if it is empty or a bound is missing."""
    one_day = F.expr("interval 1 day")
    return F.when(first <= last, F.sequence(first, last, one_day)).otherwise(F.array().cast("array<date>"))


def _days_up_to(first: Column, last: Column, limit: Column) -> Column:
    """Number of days of the closed range [first, last] that are not after ``limit``."""
    return F.greatest(F.datediff(F.least(last, limit), first) + 1, F.lit(0))


def expand_panel(df: DataFrame, id_col: str, start: str, end: str, excl_start: str | None = None,
                 excl_end: str | None = None, offset: int = 0, keep: Sequence[str] = (),
                 unique_ids: bool = False, date_col: str = "date", day_col: str = "study_day",
                 duration_col: str = "days_in_study") -> DataFrame:
    """One row per id and day of its range, without the days of a pause.

    With both pause bounds known the days are ``start..excl_start-offset`` and
    ``excl_end+offset..end``, else ``start..end``; an empty or open range gives no
    days. ``day_col`` ranks the id's distinct days from 0 (a pause uses up no
    number), ``duration_col`` counts them.

    ``unique_ids`` states that an id has one input row. Both columns then follow from
    the bounds of that row by arithmetic and nothing is shuffled.
    """
    first, last = F.col(start).cast("date"), F.col(end).cast("date")
    if excl_start and excl_end:
        paused = F.col(excl_start).isNotNull() & F.col(excl_end).isNotNull()
        stop = F.when(paused, F.date_sub(F.col(excl_start).cast("date"), offset)).otherwise(last)
        resume = F.when(paused, F.date_add(F.col(excl_end).cast("date"), offset))
    else:
        stop, resume = last, F.lit(None).cast("date")
    bounds = df.select(
        id_col, *keep, first.alias("_first"), stop.alias("_stop"), resume.alias("_resume"), last.alias("_last")
    ).filter(F.col("_first").isNotNull() & F.col("_last").isNotNull())
    first, stop, resume, last = (F.col(c) for c in ("_first", "_stop", "_resume", "_last"))
    days = F.when(resume.isNull(), _days(first, stop)).otherwise(
        F.concat(_days(first, stop), _days(resume, last))
    )
    if not unique_ids:
        rows = bounds.select(id_col, *keep, F.explode(days).alias(date_col))
        return study_day(rows, id_col, date_col, day_col, duration_col).select(
            id_col, *keep, duration_col, date_col, day_col
        )

    def distinct_up_to(limit: Column) -> Column:
        before = _days_up_to(first, stop, limit)
        after = _days_up_to(resume, last, limit)
        both = _days_up_to(F.greatest(first, resume), F.least(stop, last), limit)
        return F.when(resume.isNull(), before).otherwise(before + after - both).cast("bigint")

    rows = bounds.withColumn(date_col, F.explode(days))
    return rows.select(
        id_col, *keep, distinct_up_to(F.greatest(stop, last)).alias(duration_col), date_col,
        (distinct_up_to(F.col(date_col)) - 1).alias(day_col),
    )


def panel_from_tables(study_dates: DataFrame, excluded_dates: DataFrame, id_col: str, start: str, end: str,
                      excl_start: str, excl_end: str, offset: int = 1, keep: Sequence[str] = (),
                      unique_ids: bool = False) -> DataFrame:
    """Panel from a table of study dates and a table of pauses (full outer join on the id)."""
    ranges = full_join(study_dates, excluded_dates, [id_col])
    return expand_panel(ranges, id_col, start, end, excl_start, excl_end, offset, keep, unique_ids)

"""Ranking, neighbours, fills and calendar windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayspan.functions.ratings import count_known
from dayspan.operators.ordered import (
    Ordered,
    backward,
    following,
    group_total,
    last_known,
    next_known,
    ordered_scan,
    previous,
    running_count,
    running_sum,
    smallest_from_here,
)


def study_day(df: DataFrame, id_col: str, date_col: str = "date", out: str = "study_day",
              duration: str | None = None) -> DataFrame:
    """Rank of the date among the id's distinct dates, from 0; optionally the number of distinct dates.

    Ranks are made on distinct (id, date) pairs, of which an id has at most one per
    calendar day, and joined back, so the number of rows of an id does not matter.
    """
    days = df.select(id_col, date_col).filter(F.col(date_col).isNotNull()).distinct()
    per_id = Window.partitionBy(id_col)
    numbered = days.withColumn(out, (F.row_number().over(per_id.orderBy(date_col)) - 1).cast("bigint"))
    if duration:
        numbered = numbered.withColumn(duration, F.count(F.lit(1)).over(per_id))
    return df.join(numbered, [id_col, date_col], "left")


def number_rows(df: DataFrame, id_col: str, order: Sequence[str], out: str,
                bounded_groups: bool = False) -> DataFrame:
    """Row number within an id."""
    return ordered_scan(df, [id_col], order, {out: running_count()}, bounded_groups)


def dedupe_first_best(df: DataFrame, keys: Sequence[str], start_col: str, answer_cols: Sequence[str],
                      tie: Sequence[str]) -> DataFrame:
    """One row per key: earliest start, then most answers, then the tie-break; rows without start vanish.

    Catalyst keeps only the first row per key in every map task before it shuffles
    (window group limit), so a key with very many rows is no burden.
    """
    best = Window.partitionBy(*keys).orderBy(
        F.col(start_col).asc(), count_known(answer_cols).desc(), *[F.col(c).asc() for c in tie]
    )
    started = df.filter(F.col(start_col).isNotNull())
    return started.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") == 1).drop("_rank")


def neighbours(df: DataFrame, id_col: str, order: Sequence[str], before: dict[str, str] | None = None,
               after: dict[str, str] | None = None, bounded_groups: bool = False) -> DataFrame:
    """Values of the previous and the next row; both dicts map a new column to a source column."""
    scans = {new: previous(F.col(c)) for new, c in (before or {}).items()}
    scans |= {new: following(F.col(c)) for new, c in (after or {}).items()}
    return ordered_scan(df, [id_col], order, scans, bounded_groups)


def fill_down(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
              bounded_groups: bool = False) -> DataFrame:
    """Replace nulls by the last known value above."""
    return _fill(df, keys, order, cols, last_known, bounded_groups)


def fill_up(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
            bounded_groups: bool = False) -> DataFrame:
    """Replace nulls by the next known value below."""
    return _fill(df, keys, order, cols, next_known, bounded_groups)


def _fill(df, keys, order, cols, scan, bounded_groups):
    filled = ordered_scan(df, keys, order, {f"_f_{c}": scan(F.col(c)) for c in cols}, bounded_groups)
    return filled.select(*[F.col(f"_f_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])


def run_end(df: DataFrame, id_col: str, date_col: str, tie: Sequence[str] = (), out: str = "run_end",
            bounded_groups: bool = False) -> DataFrame:
    """Last date of the run of consecutive days that a row stands in.

    A row closes a run if the next row is not exactly one day later (a second row
    on the same day closes it too) or does not exist.
    """
    rows = Ordered(df, [id_col], [date_col, *tie], bounded_groups).scan({"_next": following(F.col(date_col))})
    gap = F.datediff("_next", date_col)
    rows.with_columns({"_end": F.when(gap.isNull() | (gap != 1), F.col(date_col))})
    return rows.scan({out: next_known(F.col("_end"))}).result("_next", "_end")


def event_within(df: DataFrame, id_col: str, date_col: str, flag_col: str, horizon: int = 7,
                 include_today: bool = True, out: str = "event_within") -> DataFrame:
    """1 if a flag is set on one of the ``horizon`` calendar days from today (or from tomorrow) on.

    Flags are summed per (id, day) first; the window then sees one row per day.
    """
    first = 0 if include_today else 1
    daily = df.groupBy(id_col, date_col).agg(F.sum(flag_col).alias("_n"))
    ahead = (
        Window.partitionBy(id_col).orderBy(F.unix_date(date_col)).rangeBetween(first, first + horizon - 1)
    )
    labelled = daily.select(
        id_col, date_col, (F.coalesce(F.sum("_n").over(ahead), F.lit(0)) >= 1).cast("int").alias(out)
    )
    return df.join(labelled, [id_col, date_col], "left")


def next_value(df: DataFrame, id_col: str, order: Sequence[str], col: str, out: str,
               bounded_groups: bool = False) -> DataFrame:
    """Value of the following row."""
    return neighbours(df, id_col, order, after={out: col}, bounded_groups=bounded_groups)


def fdr_bh(df: DataFrame, p_col: str, family: Sequence[str] = (), tie: Sequence[str] = (), out: str = "q_value",
           bounded_groups: bool = False) -> DataFrame:
    """Benjamini-Hochberg adjusted p values within a family; null p values stay null and do not count.

    Everything runs from the largest p value down: its rank is the size of the family less the p values met before
    it, and the adjusted value is the smallest p * size / rank so far. So one sort serves all of it.
    """
    p = F.col(p_col)
    known = p.isNotNull().cast("bigint")
    rows = Ordered(df, family, [p_col, *tie], bounded_groups).scan(
        {"_met": backward(running_sum(known)), "_size": backward(group_total(known))})
    rows.with_columns({"_scaled": p * F.col("_size") / (F.col("_size") - F.col("_met") + 1)})
    rows.scan({"_least": smallest_from_here(F.col("_scaled"))})
    rows.with_columns({out: F.when(p.isNotNull(), F.least(F.lit(1.0), "_least"))})
    return rows.result("_met", "_size", "_scaled", "_least")

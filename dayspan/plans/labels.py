"""Forward-looking event labels on the panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayspan.functions.ratings import if_else
from dayspan.operators.select import fill_nulls
from dayspan.plans.event_log import ED_ONLY, HOSPITAL_ONLY, SAME_DAY

# Flag column per category; the other categories have no flag of their own.
CATEGORY_FLAGS = {"ed_only": ED_ONLY, "hospital_only": HOSPITAL_ONLY, "ed_and_hospital": SAME_DAY}


def category_flags(events: DataFrame, category_col: str = "visit_category",
                   event_flag: str = "unplanned_healthcare_event") -> DataFrame:
    """Flag columns for any event and for the single categories."""
    flags = {name: if_else(F.col(category_col) == value, 1, 0) for name, value in CATEGORY_FLAGS.items()}
    return events.withColumns({event_flag: F.lit(1), **flags})


def label_windows(panel: DataFrame, events: DataFrame, id_col: str = "record_id", date_col: str = "date",
                  category_col: str = "visit_category", horizon: int = 7, keep: Sequence[str] = ("study_day",),
                  event_flag: str = "unplanned_healthcare_event") -> DataFrame:
    """Label every panel day by whether an event follows within the horizon.

    * ``..._incl_today``: an event on one of the ``horizon`` calendar days from today on.
    * ``..._incl_today_with_unknowns``: null where that is 0 but fewer than
      ``horizon`` days are left in the run of consecutive panel days.
    * ``..._excl_today_with_unknowns``: the next row's label (next panel row, also across a pause).

    A day with events of several categories gives one row per category. The panel
    has one row per id and day and the events one per id, day and category, so an
    id's rows are bounded by the calendar and the windows may hold a whole id. All
    of them share one shuffle and one sort.
    """
    label = f"{event_flag}_within_{horizon}days_incl_today"
    unknowns = f"{label}_with_unknowns"
    excluded = f"{event_flag}_within_{horizon}days_excl_today_with_unknowns"
    flags = [event_flag, *CATEGORY_FLAGS]
    joined = panel.select(id_col, date_col, *keep).join(
        category_flags(events, category_col, event_flag), [id_col, date_col], "left"
    )
    joined = fill_nulls(joined, flags, 0).withColumn("_day", F.unix_date(date_col))

    # Everything looks ahead, so the rows are sorted from the last day to the first: "next" is the
    # row before, and all frames are open towards the start, which Spark extends instead of recomputing.
    rows = Window.partitionBy(id_col).orderBy(F.col("_day").desc(), F.col(category_col).desc_nulls_first())
    calendar = Window.partitionBy(id_col).orderBy(F.col("_day").desc())
    gap = F.lag("_day").over(rows) - F.col("_day")
    ends = joined.withColumn("_end", F.when(gap.isNull() | (gap != 1), F.col("_day")))
    ends = ends.withColumn(
        "_end", F.last("_end", ignorenulls=True).over(rows.rowsBetween(Window.unboundedPreceding, 0))
    )
    ahead = F.sum(event_flag).over(calendar.rangeBetween(-(horizon - 1), 0))
    labelled = ends.withColumn(label, (ahead >= 1).cast("int"))
    labelled = labelled.withColumn("_left", F.col("_end") - F.col("_day") + 1)
    labelled = label_with_unknowns(labelled, label, "_left", horizon, unknowns)
    return labelled.withColumn(excluded, F.lag(unknowns).over(rows)).drop("_day", "_end", "_left")


def label_with_unknowns(df: DataFrame, label: str, days_left: str, horizon: int, out: str) -> DataFrame:
    """Null where the label is 0 and the remaining days do not cover the horizon; 1 stays 1."""
    cut = (F.col(label) == 0) & (F.col(days_left) < horizon)
    return df.withColumn(out, F.when(cut, None).otherwise(F.col(label)))

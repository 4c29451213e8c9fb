"""Descriptive tables: sample, events, ratings, one participant's timeline."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayspan.functions.dates import calendar_year, days_between, whole_months
from dayspan.functions.labels import n_percent
from dayspan.functions.levels import recode
from dayspan.functions.ratings import RATING_LEVELS, bin_top, rating_text
from dayspan.operators.aggregates import FoundLevels, collapse_rare, freq, freq_with_share, summarize_columns
from dayspan.operators.association import compare_groups
from dayspan.operators.joins import exists_flag, full_join_all
from dayspan.operators.reshape import melt_ratings, pivot_counts
from dayspan.operators.select import across, cols_like, subset_ids

def merge_sources(sources: Sequence[DataFrame], id_col: str, ids: DataFrame | None = None) -> DataFrame:
    """Full join of the source tables, restricted to a set of ids (the first column of ``ids``).

    With ids, these are what the sources are joined onto, so every table is read once.
    """
    within = None if ids is None else ids.select(F.col(f"`{ids.columns[0]}`").alias(id_col))
    return full_join_all(sources, [id_col], within)


def time_since(df: DataFrame, start_col: str, stop_col: str, days_out: str, months_out: str) -> DataFrame:
    """Days and completed months between two dates."""
    start, stop = F.col(start_col), F.col(stop_col)
    return df.withColumns({days_out: days_between(stop, start), months_out: whole_months(start, stop)})


def sample_characteristics(df: DataFrame, continuous: Sequence[str], levels: Mapping[str, Sequence[str]],
                           recodes: Mapping[str, Mapping[str, str]] | None = None, unknown: Sequence[str] = (),
                           rare: str | None = None, rare_below: int = 10, rare_out: str | None = None,
                           members: DataFrame | None = None, id_col: str | None = None,
                           flag: str = "had_event") -> DataFrame:
    """Summary of a sample; with ``members`` also by whether an id is among them, next to the overall column.

    ``recodes`` replaces values, ``unknown`` lists columns whose nulls become a level,
    ``rare`` collapses small categories into "Other". Levels of that column may be
    left out; they are then those of its collapsed values.
    """
    if rare:
        df = collapse_rare(df, rare, rare_below, out=rare_out)
    for col, changes in (recodes or {}).items():
        df = df.withColumn(col, recode(F.col(col), changes))
    df = across(df, list(unknown), lambda c: F.coalesce(c, F.lit("Unknown")))
    levels = dict(levels)
    rare_out = rare_out or rare
    if rare_out:
        levels.setdefault(rare_out, FoundLevels(last="Other"))
    by = None
    if members is not None:
        df, by = exists_flag(df, members, [id_col], flag), flag
    return summarize_columns(df, continuous, levels, by, add_overall=by is not None)


def compare_sample(df: DataFrame, members: DataFrame, id_col: str, continuous: Sequence[str],
                   categorical: Sequence[str], flag: str = "had_event") -> DataFrame:
    """Tests of each variable between ids with and without an event."""
    return compare_groups(exists_flag(df, members, [id_col], flag), flag, continuous, categorical)


def ids_with_events(labelled: DataFrame, id_col: str = "record_id", category_col: str = "visit_category") -> DataFrame:
    return labelled.filter(F.col(category_col).isNotNull()).select(id_col).distinct()


def encounters_per_id(labelled: DataFrame, id_col: str = "record_id", category_col: str = "visit_category") -> DataFrame:
    return freq(labelled.filter(F.col(category_col).isNotNull()), [id_col], "number_of_encounters")


def event_characteristics(labelled: DataFrame, categories: Sequence[str], years: Sequence[int] | None = None,
                          category_col: str = "visit_category", date_col: str = "date",
                          continuous: Sequence[str] = ("study_day", "hospitalization_length_of_stay_days")) -> DataFrame:
    """Summary of the events: type, year, and continuous columns; no rows for missing values.

    Without ``years`` the levels are the calendar years of the events.
    """
    events = labelled.filter(F.col(category_col).isNotNull()).withColumn("visit_year", calendar_year(F.col(date_col)))
    listed = FoundLevels() if years is None else [str(y) for y in years]
    levels = {category_col: list(categories), "visit_year": listed}
    return summarize_columns(events, continuous, levels, missing=False)


def displayed_ratings(ratings: DataFrame, keys: Sequence[str] = ("record_id", "date", "study_day"),
                      suffix: str = "_highest_rating") -> DataFrame:
    """One row per day and symptom with the rating as text."""
    cols = cols_like(ratings, ends=suffix)
    shown = across(ratings.select(*keys, *cols), cols, rating_text)
    return melt_ratings(shown, keys, cols)


def rating_frequency(labels: DataFrame, ratings: DataFrame, present_col: str,
                     keys: Sequence[str] = ("record_id", "date", "study_day"),
                     severe: Sequence[str] = ("2", "3", "4"), as_text: bool = True) -> DataFrame:
    """Share of each rating per symptom among days with a response, one column per rating."""
    answered = labels.filter(F.col(present_col).isNotNull()).select(*keys)
    long = displayed_ratings(answered.join(ratings, list(keys), "left"), keys)
    shares = freq_with_share(long, "symptom", "highest_rating", severe)
    names = list(RATING_LEVELS[1:])
    if as_text:
        shares = shares.withColumn("_cell", n_percent(F.col("n"), F.col("percent")))
        severe_cell = n_percent(F.col("subset_n"), F.col("subset_percent"))
    else:
        shares = shares.withColumn("_cell", F.col("n"))
        severe_cell = F.col("subset_n")
    shares = shares.withColumn("Moderate-to-severe", severe_cell)
    wide = pivot_counts(shares, ["symptom", "Moderate-to-severe"], "highest_rating", "_cell", names)
    return wide.select("symptom", *names, "Moderate-to-severe")


def participant_timeline(labelled: DataFrame, ratings: DataFrame, counts: DataFrame, participant,
                         count_col: str, id_col: str = "record_id", date_col: str = "date", day_col: str = "study_day",
                         event_flag: str = "unplanned_healthcare_event", cutpoint: int = 5) -> DataFrame:
    """Long frame of one id: its event flag, each rating and the binned count per day.

    The id filter is pushed to all three inputs before they are reshaped.
    """
    keys = [id_col, date_col, day_col]
    of_one = F.col(id_col) == participant
    events = labelled.filter(of_one).select(*keys, F.lit("UHE").alias("series"), F.col(event_flag).cast("string").alias("value"))
    rated = displayed_ratings(ratings.filter(of_one), keys).select(
        *keys, F.col("symptom").alias("series"), F.col("highest_rating").alias("value")
    )
    counted = counts.filter(of_one).select(
        *keys, F.lit("Number of symptoms").alias("series"), bin_top(F.col(count_col), cutpoint, "Unknown").alias("value")
    )
    return events.unionByName(rated).unionByName(counted)

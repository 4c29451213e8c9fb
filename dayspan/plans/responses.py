"""Daily responses: cleaning, one response per day, severity flags on the panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayspan.functions.labels import ITEM_NAME_RULES, name_from_text, replace_first_chain
from dayspan.functions.parsing import assign_day, to_datetime, to_number
from dayspan.functions.ratings import RATING_SUFFIXES, row_max_by_stem, severe_flag
from dayspan.operators.joins import left_join_all
from dayspan.operators.reshape import append_rows
from dayspan.operators.select import across, cols_like, fill_nulls, rename_by_mapping
from dayspan.operators.windows import dedupe_first_best

# Raw column names of a response table and what they become.
RESPONSE_COLUMNS = {
    "ResponseId": "response_id",
    "StartDate": "start_date",
    "EndDate": "end_date",
    "RecordedDate": "recorded_date",
    "Progress": "progress",
    "Duration (in seconds)": "duration_seconds",
}
# Columns of a cleaned response that are no answers.
IDENTIFIERS = ("record_id", "response_id", "date", "start_date", "progress", "duration_seconds")


def column_name_mapping(metadata: DataFrame, id_col: str = "question_id", text_col: str = "response_text_val",
                        presence_pattern: str = "symptoms") -> DataFrame:
    """Current and new column names from question metadata.

    Presence items are named from their answer text, rating items by expanding
    the abbreviations in their own name.
    """
    presence = metadata.filter(F.col(id_col).rlike(presence_pattern)).select(
        F.col(id_col).alias("current_column_name"), name_from_text(F.col(text_col)).alias("new_column_name")
    )
    rating = (
        metadata.filter(~F.coalesce(F.col(id_col).rlike(presence_pattern), F.lit(False)))
        .select(F.col(id_col).alias("current_column_name"))
        .distinct()
        .withColumn("new_column_name", replace_first_chain(F.col("current_column_name"), ITEM_NAME_RULES))
    )
    return append_rows([presence, rating])


def assign_responses_to_day(df: DataFrame, id_col: str = "record_id", columns: Mapping[str, str] = RESPONSE_COLUMNS,
                            answer_prefix: str = "d_", day_start: str = "00:00:00",
                            day_end: str = "00:00:00") -> DataFrame:
    """Select and type the response columns and give each response its day."""
    answers = cols_like(df, starts=answer_prefix)
    typed = df.select(id_col, *[F.col(f"`{old}`").alias(new) for old, new in columns.items()], *answers)
    typed = across(typed, cols_like(typed, ends="_date"), to_datetime)
    numbers = [c for c in ("progress", "duration_seconds") if c in typed.columns] + answers
    return across(typed, numbers, to_number).withColumn("date", assign_day(F.col("start_date"), day_start, day_end))


def clean_responses(df: DataFrame, progress_min: float = 50, mapping: Mapping[str, str] | None = None,
                    drop_contains: str | None = "other", id_col: str = "record_id", answer_prefix: str = "d_",
                    tie: str = "response_id") -> DataFrame:
    """Sufficiently complete responses, one per id and day, with readable column names.

    Of several responses on a day the earliest stays, then the one with most answers,
    then the smallest ``tie``. Columns whose name contains ``drop_contains`` go last.
    """
    answers = cols_like(df, starts=answer_prefix)
    kept = [id_col, *[c for c in ("response_id", "date", "start_date", "progress", "duration_seconds") if c in df.columns]]
    enough = df.filter(F.col("progress") >= progress_min).select(*kept, *answers)
    single = dedupe_first_best(enough, [id_col, "date"], "start_date", answers, [tie])
    if mapping is not None:
        single = rename_by_mapping(single, mapping)
    if drop_contains:
        single = single.drop(*cols_like(single, contains=drop_contains))
    return single


def highest_ratings(df: DataFrame, keys: Sequence[str] = ("record_id", "date"), rating_cols: Sequence[str] | None = None,
                    suffixes: Sequence[str] = RATING_SUFFIXES, match: str = "exact") -> DataFrame:
    """Largest rating per symptom and response."""
    if rating_cols is None:
        rating_cols = [c for c in df.columns if c.endswith(tuple(suffixes))]
    best = row_max_by_stem(rating_cols, suffixes, match)
    return df.select(*keys, *[value.alias(f"{stem}_highest_rating") for stem, value in best.items()])


def symptom_days(responses: DataFrame, panel: DataFrame, keys: Sequence[str] = ("record_id", "date"),
                 day_col: str = "study_day", rating_cols: Sequence[str] | None = None,
                 suffixes: Sequence[str] = RATING_SUFFIXES, match: str = "exact",
                 recode: str = "after_join") -> DataFrame:
    """Panel with the highest rating and the moderate-to-severe flag of every symptom.

    Flags of days without a response are null. A rating is -1 where a symptom was
    not endorsed; with ``recode="after_join"`` days without a response get -1 too,
    with ``"before_join"`` they stay null.
    """
    if recode not in ("after_join", "before_join"):
        raise ValueError("recode must be 'after_join' or 'before_join'")
    rated = highest_ratings(responses, keys, rating_cols, suffixes, match)
    ratings = cols_like(rated, ends="_highest_rating")
    rated = across(rated, ratings, severe_flag, lambda c: c.replace("_highest_rating", "_symptom_day"))
    if recode == "before_join":
        rated = fill_nulls(rated, ratings, -1)
    joined = left_join_all([panel.select(*keys, day_col), rated], keys)
    return joined if recode == "before_join" else fill_nulls(joined, ratings, -1)

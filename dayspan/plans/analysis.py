"""Frames for the regression models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayspan.functions.ratings import bin_top, bin_top_levels, yes_no
from dayspan.operators.joins import null_safe_join
from dayspan.operators.reshape import append_rows
from dayspan.operators.select import across, cols_like, complete_cases, select_significant, subset_ids

def outcome_column(horizon: int = 7, exclude_today: bool = False, event_flag: str = "unplanned_healthcare_event") -> str:
    """Name of the label that ``label_windows`` gives a day, with unknowns."""
    return f"{event_flag}_within_{horizon}days_{'excl' if exclude_today else 'incl'}_today_with_unknowns"


INCL_TODAY, EXCL_TODAY = outcome_column(), outcome_column(exclude_today=True)


def count_selected(labels: DataFrame, selected: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    """Sum of those flag columns whose names are in the one-column frame ``selected``.

    Null if any of them is null, 0 if none is selected. The names reach the rows as
    one scalar subquery (restricted to the column names, so bounded by the
    schema); the rows themselves are not shuffled and no name returns to the driver.
    """
    name = selected.columns[0]
    chosen = selected.filter(F.col(name).isin(*cols)).agg(F.collect_set(name)).scalar()
    with_names = labels.withColumn("_chosen", chosen)
    total = F.lit(0).cast("bigint")
    for c in cols:
        total = total + F.when(F.array_contains("_chosen", F.lit(c)), F.col(c).cast("bigint")).otherwise(0)
    return with_names.withColumn(out, total).drop("_chosen")


def count_significant(labels: DataFrame, results: Sequence[DataFrame], p_type: str = "wald", threshold: float = 0.1,
                      suffix: str = "_symptom_day",
                      out: str = "number_of_significant_individual_symptoms") -> tuple[DataFrame, DataFrame]:
    """(labels with the number of flags among the significant predictors, names of these predictors)."""
    flags = cols_like(labels, ends=suffix)
    significant = select_significant(append_rows(list(results)), p_type, threshold, f"{suffix.lstrip('_')}$")
    counted = count_selected(labels, significant, flags, out).drop(*flags)
    return counted, significant.select(F.regexp_replace("predictor", f"{suffix}$", "").alias("predictor"))


def analysis_frame(outcomes: DataFrame, predictors: DataFrame, exclude_today: bool = False,
                   keys: Sequence[str] = ("record_id", "date", "study_day"), flag_suffix: str = "_symptom_day",
                   bin_col: str | None = None, cutpoint: int = 4, complete: bool = True,
                   horizon: int = 7) -> tuple[DataFrame, dict[str, list[str]]]:
    """Outcome joined with predictors, and the levels of the categorical predictors.

    Flags become "No" / "Yes"; ``bin_col`` gets a binned copy ``<bin_col>_binned``.
    With ``complete`` only rows without any null stay.
    """
    outcome = outcome_column(horizon, exclude_today)
    frame = outcomes.select(*keys, outcome).join(predictors, list(keys), "left")
    flags = cols_like(frame, ends=flag_suffix)
    frame = across(frame, flags, yes_no)
    levels = {c: ["No", "Yes"] for c in flags}
    if bin_col:
        frame = frame.withColumn(f"{bin_col}_binned", bin_top(F.col(bin_col), cutpoint))
        levels[f"{bin_col}_binned"] = bin_top_levels(cutpoint)
    return (complete_cases(frame) if complete else frame), levels


def merge_categories(diagnoses: DataFrame, categories: DataFrame, id_col: str, source_col: str, key_col: str,
                     category_col: str, renamed_category: str, blank_cols: Sequence[str], ids=None) -> DataFrame:
    """Diagnoses with known categories (null-safe full join) and blank columns to be filled in."""
    chosen = diagnoses if ids is None else subset_ids(diagnoses, id_col, ids)
    chosen = chosen.select(id_col, F.col(source_col).alias(key_col))
    joined = null_safe_join(chosen, categories, [id_col, key_col], "full")
    return joined.withColumnRenamed(category_col, renamed_category).withColumns({c: F.lit("") for c in blank_cols})

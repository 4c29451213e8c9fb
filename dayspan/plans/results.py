"""Result tables from model result rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayspan.functions.labels import (
    format_or,
    format_p,
    interval_text,
    predictor_label,
    thousands,
    variable_label,
)
from dayspan.models.spec import INTERCEPT
from dayspan.operators.joins import null_safe_join
from dayspan.operators.reshape import with_header_rows
from dayspan.operators.windows import fdr_bh

JOIN_COLUMNS = ["n", "n_obs", "predictor", "level", "level_number", "n_per_level"]


def results_table(results: DataFrame, excluded: Sequence[str] = (), adjusted: bool = False, include_q: bool = True,
                  include_anova: bool = False) -> DataFrame:
    """Formatted odds ratios and p values, without the intercept and the excluded predictors."""
    kept = results.filter(~F.coalesce(F.col("predictor").isin(INTERCEPT, *excluded), F.lit(False)))
    if include_q:
        # A few rows per model: they fit a task.
        kept = fdr_bh(kept, "wald_p_value", tie=["predictor", "level_number"], out="_q", bounded_groups=True)
    interval = interval_text(F.col("or"), F.col("or_ci_low"), F.col("or_ci_high"))

    def p_text(column: str):
        return F.coalesce(format_p(F.col(column)), F.lit(""))

    shown = {
        "or_and_ci": F.when(F.col("or").isNull(), "*Reference*").otherwise(interval),
        "p_value": p_text("wald_p_value"),
    }
    if include_anova:
        shown["anova_p_value"] = p_text("anova_p_value")
    if include_q:
        shown["q_value"] = p_text("_q")
    prefix = "adjusted_" if adjusted else ""
    return kept.select(
        "n", "n_obs", predictor_label(F.col("predictor")).alias("predictor"), "level", "level_number", "n_per_level",
        *[c.alias(f"{prefix}{name}") for name, c in shown.items()],
    )


def individual_table(unadjusted: DataFrame, adjusted: DataFrame, excluded: Sequence[str] = ("study_day",)) -> DataFrame:
    """Unadjusted next to adjusted results with q values, a heading row per predictor."""
    left = results_table(unadjusted, excluded, False, True, False)
    right = results_table(adjusted, excluded, True, True, False)
    joined = null_safe_join(left, right, JOIN_COLUMNS, "full")
    table = with_header_rows(joined, ["predictor", "n_obs"], F.col("predictor"))
    return table.orderBy("predictor", "level_number")


def count_table(unadjusted: DataFrame, adjusted: DataFrame, excluded: Sequence[str] = ("study_day",)) -> DataFrame:
    """Unadjusted next to adjusted results; heading rows carry the global p values."""
    left = results_table(unadjusted, excluded, False, False, True)
    right = results_table(adjusted, excluded, True, False, True)
    joined = null_safe_join(left, right, JOIN_COLUMNS, "full")
    table = with_header_rows(
        joined, ["predictor", "n", "n_obs"],
        F.regexp_replace("predictor", "significant individual | binned$", ""),
        carry={"p_value": F.col("anova_p_value"), "adjusted_p_value": F.col("adjusted_anova_p_value")},
    )
    return table.drop("anova_p_value", "adjusted_anova_p_value").orderBy("predictor", "level_number")


def forest_frame(results: DataFrame) -> DataFrame:
    """Numbers and texts of a forest plot; a reference level has odds ratio 1."""
    estimated = F.col("level_number").isNull() | (F.col("level_number") > 1)
    kept = results.filter(F.col("predictor") != INTERCEPT)
    return kept.select(
        variable_label(F.col("predictor")).alias("predictor"), "class", "term", "term_label", "term_number", "level",
        "level_number", thousands(F.col("n_per_level")).alias("n_per_level"),
        F.when(estimated, F.col("or")).otherwise(F.lit(1.0)).alias("or"), "or_ci_low", "or_ci_high",
        "wald_p_value", "anova_p_value",
        F.when(estimated, F.concat(format_or(F.col("or")), F.lit(" ("), format_or(F.col("or_ci_low")), F.lit("-"),
                                   format_or(F.col("or_ci_high")), F.lit(")"))).otherwise("Reference").alias("conf_int"),
        F.when(estimated, format_p(F.col("wald_p_value"))).otherwise("").alias("p_value"),
    )

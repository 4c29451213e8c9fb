"""Fitted models as result rows, and the sweep over predictors."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession

from dayspan.functions.tails import chi2_tail
from dayspan.models.gee import CLUSTER_ROWS, Fit, gee_select
from dayspan.models.spec import INTERCEPT, ModelSpec

# The names and the order of the result columns.
RESULT_SCHEMA = (
    "model_formula string, outcome string, predictors string, interaction_terms string, n bigint, n_obs bigint, "
    "corr_structure string, se_type string, "
    "QIC double, QICu double, QICC double, CIC double, quasi_likelihood double, num_params bigint, "
    "predictor string, term string, or double, or_ci_low double, or_ci_high double, conf_level double, "
    "beta_hat double, std_error double, wald_statistic double, wald_p_value double, "
    "term_label string, class string, term_number bigint, level string, level_number bigint, n_per_level bigint, "
    "anova_statistic string, anova_chi_sq double, anova_df bigint, anova_p_value double"
)


REPORT_SCHEMA = (
    "model_formula string, outcome string, corr_structure string, converged boolean, reason string, iterations bigint, "
    "smallest_eigenvalue double, largest_coefficient double, n bigint, n_obs bigint"
)


def _number(value: float) -> float | None:
    return float(value) if math.isfinite(value) else None


def _exp(value: float) -> float | None:
    return math.exp(value) if math.isfinite(value) and value < 709 else (math.inf if value >= 709 else None)


def result_rows(fit: Fit, conf_level: float = 0.95) -> list[dict]:
    """Rows of one model: intercept, then terms and levels; reference levels without estimates."""
    spec = fit.spec
    model = {
        "model_formula": spec.formula, "outcome": spec.outcome, "predictors": spec.predictor_text,
        "interaction_terms": spec.interaction_text, "n": fit.n_clusters, "n_obs": fit.n_obs,
        "corr_structure": fit.corr, "se_type": "san.se",
        "QIC": _number(fit.qic), "QICu": _number(fit.qicu), "QICC": _number(fit.qicc), "CIC": _number(fit.cic),
        "quasi_likelihood": _number(fit.quasi_likelihood), "num_params": fit.num_params,
    }
    quantile = NormalDist().inv_cdf(0.5 + conf_level / 2)

    def estimates(i: int) -> dict:
        b, se = fit.beta[i], fit.std_error[i]
        wald = (b / se) ** 2 if se > 0 else math.nan
        return {
            "or": _exp(b), "or_ci_low": _exp(b - quantile * se), "or_ci_high": _exp(b + quantile * se),
            "conf_level": conf_level, "beta_hat": _number(b), "std_error": _number(se),
            "wald_statistic": _number(wald), "wald_p_value": chi2_tail(_number(wald), 1),
        }

    def global_test(predictor: str) -> dict:
        chi, df = fit.wald([i for i, c in enumerate(fit.columns) if predictor in c.term])
        return {
            "anova_statistic": "Wald statistic", "anova_chi_sq": _number(chi), "anova_df": df,
            "anova_p_value": chi2_tail(_number(chi), df),
        }

    rows = [{**model, "predictor": INTERCEPT, "term": INTERCEPT, **estimates(0)}]
    for number, term in enumerate(spec.terms, start=1):
        at = [i for i, c in enumerate(fit.columns) if c.term == term]
        label = ":".join(term)
        shared = {**model, "predictor": label, "term_label": label, "term_number": number}
        if len(term) > 1:
            rows += [{**shared, "term": fit.columns[i].name, **estimates(i)} for i in at]
            continue
        shared |= global_test(term[0])
        if term[0] not in fit.levels:
            rows.append({**shared, "class": "numeric", "term": label, "n_per_level": fit.n_obs, **estimates(at[0])})
            continue
        shared["class"] = "factor"
        levels = list(fit.levels[term[0]])
        counts = [int(round(fit.column_sums[i])) for i in at]
        rows.append({**shared, "term": f"{label}{levels[0]}", "level": levels[0], "level_number": 1,
                     "n_per_level": fit.n_obs - sum(counts)})
        for k, (i, level) in enumerate(zip(at, levels[1:])):
            rows.append({**shared, "term": fit.columns[i].name, "level": level, "level_number": k + 2,
                         "n_per_level": counts[k], **estimates(i)})
    return rows


def gee_results(spark: SparkSession, fits: Sequence[Fit], conf_level: float = 0.95, report: bool = False) -> DataFrame:
    """Result rows of several models (a few rows per model) as one frame; ``report`` adds whether and why a fit ended."""
    names = [part.split()[0] for part in RESULT_SCHEMA.split(", ")]
    rows = [
        tuple(row.get(c) for c in names) + ((fit.converged, fit.reason, fit.iterations) if report else ())
        for fit in fits for row in result_rows(fit, conf_level)
    ]
    more = ", converged boolean, reason string, iterations bigint" if report else ""
    return spark.createDataFrame(rows, RESULT_SCHEMA + more)


def fit_report(spark: SparkSession, fits: Sequence[Fit]) -> DataFrame:
    """One row per model: did it converge, in how many passes, and if not, why.

    Reasons are "converged", "separated" (a predictor tells the outcomes apart, so its odds ratio has no finite estimate),
    "singular" (columns depend on each other) and "not settled". The smallest eigenvalue is that of the information, scaled
    to a unit diagonal, at the last pass.
    """
    rows = [
        (f.spec.formula, f.spec.outcome, f.corr, f.converged, f.reason, f.iterations, _number(f.smallest_eigenvalue),
         f.largest_coefficient, f.n_clusters, f.n_obs) for f in fits
    ]
    return spark.createDataFrame(rows, REPORT_SCHEMA)


def sweep_fits(df: DataFrame, outcome: str, predictors: Sequence[str], covariates: Sequence[str], id_col: str,
               order: Sequence[str], levels: Mapping[str, Sequence[str]] | None = None,
               cluster_rows: int = CLUSTER_ROWS) -> tuple[list[Fit], list[Fit]]:
    """(univariable fits, covariate-adjusted fits).

    One model per predictor and covariate, and one per predictor with all covariates.
    All of them are fitted in the same passes over the data.
    """
    single = [ModelSpec(outcome, (p,)) for p in [*predictors, *covariates]]
    adjusted = [ModelSpec(outcome, (*covariates, p)) for p in predictors]
    by_formula = {f.spec.formula: f for f in gee_select(df, [*single, *adjusted], id_col, order, levels, cluster_rows)}

    def of(specs: Sequence[ModelSpec]) -> list[Fit]:
        return [by_formula[s.formula] for s in specs if s.formula in by_formula]

    return of(single), of(adjusted)


def gee_sweep(df: DataFrame, outcome: str, predictors: Sequence[str], covariates: Sequence[str], id_col: str,
              order: Sequence[str], levels: Mapping[str, Sequence[str]] | None = None, conf_level: float = 0.95,
              cluster_rows: int = CLUSTER_ROWS) -> tuple[DataFrame, DataFrame]:
    """Result rows of ``sweep_fits``: (univariable results, covariate-adjusted results)."""
    fits = sweep_fits(df, outcome, predictors, covariates, id_col, order, levels, cluster_rows)
    return tuple(gee_results(df.sparkSession, part, conf_level) for part in fits)

"""From single symptoms to their number: sweep, selection, recount and refit, each step written so that it can be resumed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayspan.models.gee import gee_select
from dayspan.models.results import gee_results, gee_sweep
from dayspan.models.spec import ModelSpec
from dayspan.operators.select import cols_like
from dayspan.plans.analysis import analysis_frame, count_significant, outcome_column


class Steps:
    """Tables under one folder, each built once: a step that is complete there is read instead of computed."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def complete(self, name: str) -> bool:
        """A step is complete if Spark has marked its output as committed."""
        marker = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/_SUCCESS")
        return marker.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(marker)

    def step(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if not self.complete(name):
            build().write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.parquet(self.path(name))


def refit_on_symptom_count(outcomes: DataFrame, flags: DataFrame, covariates: Sequence[str], id_col: str, order: Sequence[str], root: str,
                           exclude_today: bool = False, horizon: int = 7, p_type: str = "wald", threshold: float = 0.1, cutpoint: int = 4,
                           select_adjusted: bool = True, suffix: str = "_symptom_day",
                           keys: Sequence[str] = ("record_id", "date", "study_day"),
                           count_col: str = "number_of_significant_individual_symptoms") -> DataFrame:
    """Result rows of the outcome on the binned number of significant symptoms, without and with the covariates.

    ``outcomes`` holds the labels, ``flags`` the keys and one 0/1 column per symptom. Steps under ``root``: ``sweep`` (result
    rows of every symptom alone and with the covariates), ``significant`` (names of the selected ones), ``counts`` (days with
    the binned number of selected symptoms), ``refit``. A run that was interrupted goes on behind its last complete step;
    dropping a step's folder and those after it repeats them.
    """
    steps, spark = Steps(flags.sparkSession, root), flags.sparkSession
    outcome = outcome_column(horizon, exclude_today)
    names = cols_like(flags, ends=suffix)

    def sweep() -> DataFrame:
        frame, levels = analysis_frame(outcomes, flags, exclude_today, keys, suffix, horizon=horizon)
        single, adjusted = gee_sweep(frame, outcome, names, covariates, id_col, order, levels)
        return single.withColumn("adjusted", F.lit(False)).unionByName(adjusted.withColumn("adjusted", F.lit(True)))

    results = steps.step("sweep", sweep)
    judged = results if select_adjusted else results.filter("NOT adjusted")
    counted, _ = count_significant(flags, [judged], p_type, threshold, suffix, count_col)
    steps.step("significant", lambda: count_significant(flags, [judged], p_type, threshold, suffix, count_col)[1])
    binned = f"{count_col}_binned"
    frame, levels = analysis_frame(outcomes, counted.select(*keys, count_col), exclude_today, keys, suffix, count_col, cutpoint, horizon=horizon)
    frame = steps.step("counts", lambda: frame)

    def refit() -> DataFrame:
        specs = [ModelSpec(outcome, (binned,)), ModelSpec(outcome, (*covariates, binned))]
        return gee_results(spark, gee_select(frame, specs, id_col, order, levels), report=True)

    return steps.step("refit", refit)

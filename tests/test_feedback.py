"""Sweep, selection, recount and refit in resumable steps."""

import datetime
import os

import numpy as np
import pytest

from dayspan.plans import feedback
from dayspan.plans.analysis import analysis_frame, outcome_column
from dayspan.plans.feedback import Steps, refit_on_symptom_count

KEYS = ["record_id", "date", "study_day"]


def cohort(spark, horizon):
    """Days on which an event goes with the first two symptoms and not with the third."""
    rng = np.random.default_rng(2)
    first, rows, flags = datetime.date(2024, 1, 1), [], []
    for i in range(90):
        for d in range(25):
            a, b, c = (int(rng.random() < 0.4) for _ in range(3))
            y = int(rng.random() < 1 / (1 + np.exp(1.2 - 1.0 * a - 0.9 * b)))
            day = first + datetime.timedelta(d)
            rows.append((i, day, d, None if d > 22 else y))
            flags.append((i, day, d, None if d == 5 else a, b, c))
    labels = spark.createDataFrame(rows, f"record_id int, date date, study_day int, {outcome_column(horizon)} int")
    return labels, spark.createDataFrame(flags, "record_id int, date date, study_day int, a_symptom_day int, b_symptom_day int, c_symptom_day int")


def test_names_of_the_outcome():
    assert outcome_column() == "unplanned_healthcare_event_within_7days_incl_today_with_unknowns"
    assert outcome_column(14, True) == "unplanned_healthcare_event_within_14days_excl_today_with_unknowns"


def test_refit_and_resume(spark, tmp_path, monkeypatch):
    horizon = 14
    labels, flags = cohort(spark, horizon)
    root = str(tmp_path / "steps")
    arguments = (labels, flags, ["study_day"], "record_id", ["date"], root)
    out = refit_on_symptom_count(*arguments, horizon=horizon, threshold=0.001, cutpoint=2).collect()
    assert sorted(r["predictor"] for r in Steps(spark, root).step("significant", None).collect()) == ["a", "b"]
    models = {r["model_formula"].split(" ~ ")[1] for r in out}
    name = "number_of_significant_individual_symptoms_binned"
    assert models == {name, f"study_day + {name}"} and all(r["converged"] for r in out)
    odds = {r["level"]: r["or"] for r in out if r["predictor"] == name and r["predictors"] == name}
    assert odds["0"] is None and 1.5 < odds["1"] < odds["2+"]
    counted = Steps(spark, root).step("counts", None)
    assert counted.count() == 90 * 22  # days without a flag or a label are out
    # Interrupted after the sweep: it isn't fitted again, the rest is.
    calls = []
    real = feedback.gee_sweep
    monkeypatch.setattr(feedback, "gee_sweep", lambda *a, **k: calls.append(1) or real(*a, **k))
    os.remove(f"{root}/refit/_SUCCESS")
    again = refit_on_symptom_count(*arguments, horizon=horizon, threshold=0.001, cutpoint=2).collect()
    assert not calls and sorted(map(str, again)) == sorted(map(str, out))
    os.remove(f"{root}/sweep/_SUCCESS")
    refit_on_symptom_count(*arguments, horizon=horizon, threshold=0.001, cutpoint=2)
    assert calls == [1]


def test_frame_of_another_horizon(spark):
    labels, flags = cohort(spark, 14)
    frame, levels = analysis_frame(labels, flags, horizon=14)
    assert outcome_column(14) in frame.columns and set(levels) == {"a_symptom_day", "b_symptom_day", "c_symptom_day"}
    with pytest.raises(Exception, match="7days"):
        analysis_frame(labels, flags)

"""Response cleaning, ratings and symptom days."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dayspan.functions.parsing import assign_day, parse_mdy, to_datetime, to_number
from dayspan.functions.ratings import bin_top, bin_top_levels, rating_text, row_max_by_stem, severe_flag
from dayspan.operators.windows import dedupe_first_best
from dayspan.plans.analysis import analysis_frame, count_selected, count_significant
from dayspan.plans.cohort import rating_frequency
from dayspan.plans.responses import (
    assign_responses_to_day,
    clean_responses,
    column_name_mapping,
    highest_ratings,
    symptom_days,
)

D = dt.date(2024, 5, 1)
RAW = ("record_id int, ResponseId string, StartDate string, EndDate string, RecordedDate string, Progress string, "
       "`Duration (in seconds)` string, d_naus_sev string, d_app_sev string, d_other1_sev string")


def raw(spark, rows):
    return spark.createDataFrame([(i, rid, s, s, s, p, "60", *answers) for i, rid, s, p, answers in rows], RAW)


def test_clean_responses(spark):
    rows = [
        (1, "r1", "2024-05-01 08:00:00", "49", ("1", "1", None)),
        (1, "r2", "2024-05-01 09:00:00", "50", ("1", None, None)),
        (1, "r3", "2024-05-01 09:00:00", "100", ("2", "x", "3")),
        (1, "r4", "2024-05-01 10:00:00", "100", ("4", "4", "4")),
        (1, "r5", "2024-05-02 00:00:00", None, ("4", "4", "4")),
        (1, "r7", "2024-05-03 10:00:00", "80", ("1", "1", None)),
        (1, "r6", "2024-05-03 10:00:00", "80", ("0", "0", None)),
        (2, "r8", None, "80", ("1", "1", "1")),
        (2, "r9", "not a time", "80", ("1", "1", "1")),
    ]
    typed = assign_responses_to_day(raw(spark, rows))
    cleaned = clean_responses(typed, mapping={"d_naus_sev": "nausea_sev", "d_app_sev": "decreased_appetite_sev", "d_other1_sev": "other_sev"})
    assert cleaned.columns == ["record_id", "response_id", "date", "start_date", "progress", "duration_seconds",
                               "nausea_sev", "decreased_appetite_sev"]
    got = sorted((r["record_id"], r["response_id"], r["date"], r["nausea_sev"], r["decreased_appetite_sev"]) for r in cleaned.collect())
    assert got == [(1, "r3", D, 2.0, None), (1, "r6", D + dt.timedelta(days=2), 0.0, 0.0)]
    again = clean_responses(cleaned.withColumnsRenamed({"nausea_sev": "d_n", "decreased_appetite_sev": "d_a"}))
    assert again.count() == cleaned.count()
    with pytest.raises(ValueError):
        clean_responses(typed, mapping={"absent": "x"})
    with pytest.raises(ValueError):
        clean_responses(typed, mapping={})


def test_dedupe_limits_rows_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, 1, 2, 3)], "k int, s int, a int, t int")
    plan = dedupe_first_best(df, ["k"], "s", ["a"], ["t"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_day_boundary(spark):
    times = ["00:00:00", "00:30:00", "01:59:59", "02:00:00", "23:59:59"]
    df = spark.createDataFrame([(t,) for t in times], "t string").withColumn("ts", to_datetime(F.concat(F.lit("2024-05-01 "), "t")))
    shifted = {r["t"]: r["d"] for r in df.select("t", assign_day(F.col("ts"), "00:00:00", "02:00:00").alias("d")).collect()}
    assert [(D - shifted[t]).days for t in times] == [0, 1, 1, 0, 0]
    assert all(r["d"] == D for r in df.select(assign_day(F.col("ts")).alias("d")).collect())


def test_parsing(spark):
    df = spark.createDataFrame([("1/2/24", " 3.5 "), ("12/31/68", "x"), ("01/01/69", None), ("nope", "1e3"), (None, "")], "d string, n string")
    got = df.select(parse_mdy(F.col("d")).alias("d"), to_number(F.col("n")).alias("n")).collect()
    assert [r["d"] for r in got] == [dt.date(2024, 1, 2), dt.date(2068, 12, 31), dt.date(1969, 1, 1), None, None]
    assert [r["n"] for r in got] == [3.5, None, None, 1000.0, None]


RATINGS = "record_id int, date date, pain_sev double, pain_freq double, pain_in_the_abdomen_sev double, solo_sev double"


def ratings(spark):
    return spark.createDataFrame(
        [(1, D, None, None, 3.0, 0.0), (2, D, 1.0, 4.0, None, None), (3, D, None, None, None, 2.0), (4, D, 0.0, 1.0, 2.0, 1.0)], RATINGS)


def test_highest_ratings(spark):
    exact = {r["record_id"]: tuple(r)[2:] for r in highest_ratings(ratings(spark)).collect()}
    assert exact == {1: (None, 3.0, 0.0), 2: (4.0, None, None), 3: (None, None, 2.0), 4: (1.0, 2.0, 1.0)}
    wide = {r["record_id"]: r["pain_highest_rating"] for r in highest_ratings(ratings(spark), match="substring").collect()}
    assert wide == {1: 3.0, 2: 4.0, 3: None, 4: 2.0}
    with pytest.raises(ValueError):
        row_max_by_stem([])
    with pytest.raises(ValueError):
        row_max_by_stem(["a_sev"], match="fuzzy")


def test_symptom_days(spark):
    panel = spark.createDataFrame([(i, D, 0) for i in (1, 2, 9)], "record_id int, date date, study_day int")
    after = {r["record_id"]: r for r in symptom_days(ratings(spark), panel).collect()}
    assert set(after) == {1, 2, 9}
    assert (after[1]["pain_highest_rating"], after[1]["pain_symptom_day"]) == (-1.0, 0)
    assert (after[2]["pain_highest_rating"], after[2]["pain_symptom_day"]) == (4.0, 1)
    assert (after[9]["pain_highest_rating"], after[9]["pain_symptom_day"]) == (-1.0, None)
    before = {r["record_id"]: r for r in symptom_days(ratings(spark), panel, recode="before_join").collect()}
    assert before[9]["pain_highest_rating"] is None and before[1]["pain_highest_rating"] == -1.0


def test_scalar_ratings(spark):
    df = spark.createDataFrame([(v,) for v in (None, -1.0, 0.0, 1.0, 2.0, 4.0, 5.0)], "v double")
    got = df.select(severe_flag(F.col("v")).alias("s"), rating_text(F.col("v")).alias("t"), bin_top(F.col("v"), 4).alias("b"),
                    bin_top(F.col("v"), 5, "Unknown").alias("u")).collect()
    assert [r["s"] for r in got] == [0, 0, 0, 0, 1, 1, 0]
    assert [r["t"] for r in got] == ["Unknown", "Not endorsed or 0", "Not endorsed or 0", "1", "2", "4", "5"]
    assert [r["b"] for r in got] == [None, "-1", "0", "1", "2", "4+", "4+"]
    assert got[0]["u"] == "Unknown" and got[-1]["u"] == "5+"
    assert bin_top_levels(4) == ["0", "1", "2", "3", "4+"]
    for bad in (0, -1, 2.5):
        with pytest.raises(ValueError):
            bin_top(F.col("v"), bad)


def test_column_name_mapping(spark):
    metadata = spark.createDataFrame(
        [
            ("d_symptoms_1", "Diarrhea (loose stools)"), ("d_symptoms_2", "Numbness or tingling, any"),
            ("d_symptoms_3", "Pain in the abdomen (e.g., cramps)"), ("d_painabd_sev", "None"), ("d_painabd_sev", "Mild"),
            ("d_sob_int", "x"), ("d_ins_freq", "x"), ("d_app_sev", "x"), ("d_const_sev", "x"), ("d_conc_sev", "x"), ("d_sad_freq", "x"),
        ],
        "question_id string, response_text_val string")
    got = {r[0]: r[1] for r in column_name_mapping(metadata).collect()}
    assert got == {
        "d_symptoms_1": "diarrhea", "d_symptoms_2": "neuropathy", "d_symptoms_3": "pain_in_the_abdomen",
        "d_painabd_sev": "pain_in_the_abdomen_sev", "d_sob_int": "shortness_of_breath_int", "d_ins_freq": "insomnia_freq",
        "d_app_sev": "decreased_appetite_sev", "d_const_sev": "constipation_sev",
        "d_conc_sev": "problems_with_concentration_sev", "d_sad_freq": "sad_or_unhappy_feelings_freq",
    }


def test_count_selected(spark):
    labels = spark.createDataFrame([(1, 1, 1, 0), (2, None, 1, 1), (3, 0, 0, None)], "id int, a_symptom_day int, b_symptom_day int, c_symptom_day int")
    names = spark.createDataFrame([("a_symptom_day",), ("b_symptom_day",), ("other",)], "name string")
    cols = ["a_symptom_day", "b_symptom_day", "c_symptom_day"]
    got = {r["id"]: r["n"] for r in count_selected(labels, names, cols, "n").collect()}
    assert got == {1: 2, 2: None, 3: 0}
    nothing = count_selected(labels, names.filter("name = 'other'"), cols, "n")
    assert {r["n"] for r in nothing.collect()} == {0}
    results = spark.createDataFrame(
        [("a_symptom_day", 1.0, 0.05, 0.5), ("b_symptom_day", 0.99, 0.01, 0.01), ("c_symptom_day", 2.0, None, 0.01), ("study_day", 2.0, 0.0, 0.0)],
        "predictor string, or double, wald_p_value double, anova_p_value double")
    counted, chosen = count_significant(labels, [results, results])
    assert [r[0] for r in chosen.collect()] == ["a"]
    assert counted.columns == ["id", "number_of_significant_individual_symptoms"]
    assert [r[0] for r in count_significant(labels, [results], "anova")[1].collect()] == ["c"]


def test_count_selected_does_not_shuffle_rows(spark):
    labels = spark.range(100).selectExpr("id", "id % 2 AS a_symptom_day")
    names = spark.createDataFrame([("a_symptom_day",)], "name string")
    plan = count_selected(labels, names, ["a_symptom_day"], "n")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Subquery")[0]


def test_analysis_frame(spark):
    label = "unplanned_healthcare_event_within_7days_{}_today_with_unknowns"
    outcomes = spark.createDataFrame(
        [(1, D, 0, 1, None), (2, D, 0, None, 0), (3, D, 0, 0, 0)],
        f"record_id int, date date, study_day int, {label.format('incl')} int, {label.format('excl')} int")
    predictors = spark.createDataFrame([(1, D, 0, 1, 5), (2, D, 0, 0, 1), (3, D, 0, None, 2)], "record_id int, date date, study_day int, a_symptom_day int, n int")
    frame, levels = analysis_frame(outcomes, predictors, bin_col="n", cutpoint=4)
    assert [(r["record_id"], r["a_symptom_day"], r["n_binned"]) for r in frame.collect()] == [(1, "Yes", "4+")]
    assert levels == {"a_symptom_day": ["No", "Yes"], "n_binned": ["0", "1", "2", "3", "4+"]}
    assert [r["record_id"] for r in analysis_frame(outcomes, predictors, exclude_today=True)[0].collect()] == [2]
    assert analysis_frame(outcomes, predictors, complete=False)[0].count() == 3


def test_rating_frequency_text(spark):
    rows = [(i, D, 0, 0, float(i % 3) if i % 4 else -1.0) for i in range(1200)] + [(5000, D, 0, None, 3.0)]
    labels = spark.createDataFrame(rows, "record_id int, date date, study_day int, a_symptom_day int, sore_throat_highest_rating double")
    got = rating_frequency(labels.drop("sore_throat_highest_rating"), labels.drop("a_symptom_day"), "a_symptom_day").collect()
    assert len(got) == 1
    assert got[0].asDict() == {"symptom": "Sore throat", "Not endorsed or 0": "600 (50%)", "1": "300 (25%)", "2": "300 (25%)",
                               "3": None, "4": None, "Moderate-to-severe": "300 (25%)"}

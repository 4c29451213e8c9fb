"""Selection, joins, reshaping, summaries, association tests, formatting and result tables."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from dayspan.functions.dates import whole_months
from dayspan.functions.labels import (
    format_or,
    format_p,
    n_percent,
    predictor_from_term,
    predictor_label,
    replace_first_chain,
    variable_label,
)
from dayspan.functions.levels import levels_with_last, recode, with_levels
from dayspan.functions.tails import chi2_tail, chi_square_tail, erfc, normal_tail
from dayspan.operators.aggregates import collapse_rare, freq_with_share, level_counts, summarize_columns
from dayspan.operators.association import chi_square, permutation_test, rank_sum
from dayspan.operators.joins import exists_flag, full_join, full_join_all, null_safe_join
from dayspan.operators.reshape import pivot_counts
from dayspan.operators.select import cols_like, rename_by_mapping, subset_ids
from dayspan.plans.analysis import merge_categories
from dayspan.plans.results import count_table, forest_frame, individual_table, results_table


def column(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_format_p(spark):
    values = [0.0004, 0.001, 0.0049, 0.0096, 0.012, 0.047, 0.0496, 0.05, 0.2, 0.5, 0.994, 0.997, 1.0, 0.0, None]
    assert column(spark, values, "double", format_p) == [
        "<.001", ".001", ".005", ".01", ".01", ".047", ".05", ".05", ".20", ".50", ".99", ">.99", ">.99", "<.001", None]


def test_format_or(spark):
    assert column(spark, [1.0, 1.5, 10.0, 100.0, 0.1234, None], "double", format_or) == ["1.00", "1.50", "10.00", "100.00", "0.12", None]


def test_labels(spark):
    assert column(spark, ["decreased_appetite_symptom_day", "study_day", None], "string", predictor_label) == ["Decreased appetite", "Study day", None]
    assert column(spark, ["promis_depression", "age_years_collapsed", "forhp_rural_zipcode", "weekend_day"], "string", variable_label) == [
        "Promis Depression", "Age (years, centered at mean)", "Rural zip code", "Weekend"]
    assert column(spark, ["pain_symptom_dayYes", "(Intercept)", "n_binned4+", "n_binned3", "study_day"], "string", predictor_from_term) == [
        "pain_symptom_day", "(Intercept)", "n_binned", "n_binned", "study_day"]
    assert column(spark, ["d_const_sev", "d_conc_freq", "d_app_app", "d_insins"], "string", replace_first_chain) == [
        "constipation_sev", "problems_with_concentration_freq", "decreased_appetite_app", "insomniains"]
    df = spark.createDataFrame([(1234567, 12.0), (5, 12.5), (0, 100.0), (7, 0.0), (9, 33.33)], "n bigint, p double")
    assert [r[0] for r in df.select(n_percent(F.col("n"), F.col("p"))).collect()] == [
        "1,234,567 (12%)", "5 (12.5%)", "0 (100%)", "7 (0%)", "9 (33.33%)"]


def test_whole_months(spark):
    pairs = [("2024-01-31", "2024-02-29", 0), ("2024-01-15", "2024-02-15", 1), ("2024-01-15", "2024-02-14", 0),
             ("2023-12-31", "2024-12-30", 11), ("2024-03-10", "2024-01-10", -2), ("2024-03-10", "2024-01-09", -3)]
    df = spark.createDataFrame(pairs, "a string, b string, m int")
    got = df.select(whole_months(F.col("a").cast("date"), F.col("b").cast("date")).alias("g"), "m").collect()
    assert [r["g"] for r in got] == [r["m"] for r in got]


def test_levels(spark):
    assert column(spark, ["a", "z", None], "string", lambda c: with_levels(c, ["a", "b"])) == ["a", None, None]
    assert column(spark, ["3 or 4", "1", None], "string", lambda c: recode(c, {"3 or 4": "4"}, "Unknown")) == ["4", "1", "Unknown"]
    assert levels_with_last(["b", "Other", "a", "b"]) == ["a", "b", "Other"]


def test_selection(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "id int")
    ids = spark.createDataFrame([(5,), (5,), (None,)], "x int")
    for members in (ids, [5], range(4, 7)):
        assert [r[0] for r in subset_ids(df, "id", members).collect()] == [5]
        assert {r[0] for r in subset_ids(df, "id", members, include=False).collect()} == {1, None}
    assert subset_ids(df, "id", []).count() == 0 and subset_ids(df, "id", [], include=False).count() == 3
    wide = spark.createDataFrame([(1, 2, 3)], "d_Pain int, D_other int, x_date int")
    assert cols_like(wide, starts="d_") == ["d_Pain", "D_other"] and cols_like(wide, contains="OTHER") == ["D_other"]
    assert cols_like(wide, ends="_DATE") == ["x_date"] and cols_like(wide, regex="^d_") == ["d_Pain"]
    with pytest.raises(ValueError):
        rename_by_mapping(wide, {"absent": "y"})


def test_full_joins(spark):
    a = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c"), (2, "d")], "k int, x string")
    b = spark.createDataFrame([(1, "p"), (None, "q"), (3, "r"), (2, "s"), (2, "t")], "k int, y string")
    plain = {tuple(r) for r in full_join(a, b, ["k"]).select("k", "x", "y").collect()}
    both = {(1, "a", "p"), (2, "c", "s"), (2, "c", "t"), (2, "d", "s"), (2, "d", "t"), (3, None, "r")}
    assert plain == both | {(None, "b", None), (None, None, "q")}
    safe = {tuple(r) for r in null_safe_join(a, b, ["k"]).select("k", "x", "y").collect()}
    assert safe == both | {(None, "b", "q")}
    assert {tuple(r) for r in null_safe_join(a, b, ["k"], "left").select("k", "x", "y").collect()} == safe - {(3, None, "r")}


def test_full_joins_run_no_job_while_they_are_planned(spark):
    frame = spark.range(10).withColumnRenamed("id", "k")
    spark.sparkContext.setJobGroup("planning", "full joins")
    try:
        full_join_all([frame.withColumn(c, F.col("k")) for c in "abc"], ["k"])
        null_safe_join(frame.withColumn("a", F.col("k")), frame.withColumn("b", F.col("k")), ["k"])
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_merge_categories_matches_null_with_null(spark):
    a = spark.createDataFrame([(1, None), (2, "lung"), (9, "skin")], "record_id int, cancer_type string")
    b = spark.createDataFrame([(1, None, "none"), (3, "gi", "GI")], "record_id int, source string, cancer_type string")
    got = merge_categories(a, b, "record_id", "cancer_type", "source", "cancer_type", "first", ["second", "notes"], ids=range(1, 5))
    assert {tuple(r) for r in got.collect()} == {(1, None, "none", "", ""), (2, "lung", None, "", ""), (3, "gi", "GI", "", "")}


def test_summaries(spark):
    rows = [(1, 10.0, "a", "x"), (2, None, "b", "x"), (3, 30.0, "a", "y"), (4, 20.0, None, "y"), (5, 40.0, "other", "y")]
    df = spark.createDataFrame(rows, "id int, v double, c string, g string")
    got = {(r["variable"], r["level"], r["stratum"]): r for r in
           summarize_columns(df, ["v"], {"c": ["a", "b", "z"]}, "g", add_overall=True).collect()}
    overall = got["v", None, "Overall"]
    assert (overall["n"], overall["n_missing"], overall["mean"], overall["min"], overall["max"]) == (4, 1, 25.0, 10.0, 40.0)
    assert overall["sd"] == pytest.approx(math.sqrt(500 / 3))
    assert got["v", None, "x"]["n"] == 1 and got["v", None, "x"]["sd"] is None
    assert (got["c", "a", "Overall"]["n"], got["c", "a", "Overall"]["percent"]) == (2, pytest.approx(200 / 3))
    assert got["c", "z", "x"]["n"] == 0 and got["c", "z", "x"]["percent"] == 0
    assert got["c", "Unknown", "y"]["n"] == 2 and ("c", "Unknown", "x") not in got
    assert {k[1] for k in got if k[0] == "c"} == {"a", "b", "z", "Unknown"}
    without = summarize_columns(df, [], {"c": ["a", "b"]}, missing=False).collect()
    assert {(r["level"], r["n"]) for r in without} == {("a", 2), ("b", 1)}


def test_counts(spark):
    df = spark.createDataFrame([("s", "1")] * 3 + [("s", "2")] + [("t", "2")], "k string, v string")
    got = {(r["k"], r["v"]): r for r in freq_with_share(df, "k", "v", ["2"]).collect()}
    assert (got["s", "1"]["percent"], got["s", "1"]["subset_n"], got["t", "2"]["subset_percent"]) == (75.0, 1, 100.0)
    rare = spark.createDataFrame([("a",)] * 10 + [("b",)] * 9 + [(None,)] * 3, "c string")
    assert {r[0]: r[1] for r in collapse_rare(rare, "c").groupBy("c").count().collect()} == {"a": 10, "Other": 12}
    assert {r[0]: r[2] for r in level_counts(rare, "c", ["a", "q"]).collect()} == {"a": 10, "q": 0}
    wide = pivot_counts(df.groupBy("k", "v").count(), ["k"], "v", "count", ["1", "2", "3"]).filter("k = 's'").first()
    assert (wide["1"], wide["2"], wide["3"]) == (3, 1, None)
    flags = exists_flag(df, df.filter("v = '1'"), ["k"], "f")
    assert {(r["k"], r["f"]) for r in flags.collect()} == {("s", "Yes"), ("t", "No")}


def test_tails(spark):
    xs = [0.0, 0.1, 0.5, 1.0, 1.9, 2.0, 3.0, 5.0, 10.0]
    for got, x in zip(column(spark, xs, "double", erfc), xs):
        assert got == pytest.approx(math.erfc(x), rel=1e-11)
    assert column(spark, [1.959963984540054], "double", normal_tail)[0] == pytest.approx(0.05, abs=1e-12)
    cases = [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05), (18.307038053275146, 10, 0.05), (0.0, 4, 1.0)]
    df = spark.createDataFrame(cases, "s double, d bigint, p double")
    for r in df.select(chi_square_tail(F.col("s"), F.col("d")).alias("g"), "s", "d", "p").collect():
        assert r["g"] == pytest.approx(r["p"], abs=1e-10)
        assert chi2_tail(r["s"], r["d"]) == pytest.approx(r["p"], abs=1e-10)
    wide = spark.createDataFrame([(float(s), d) for s in (1, 50, 2000, 5000) for d in (1, 7, 2001)], "s double, d bigint")
    for r in wide.select(chi_square_tail(F.col("s"), F.col("d")).alias("g"), "s", "d").collect():
        assert r["g"] == pytest.approx(chi2_tail(r["s"], r["d"]), rel=1e-9, abs=1e-300)


GROUPED = [(("a", "b", "c")[i % 3], "Yes" if i * i % 7 in (1, 2) else "No", float(i * 13 % 11)) for i in range(90)]


@pytest.mark.parametrize("partitions", [1, 9])
def test_rank_sum(spark, partitions):
    df = spark.createDataFrame(GROUPED, "c string, g string, v double").repartition(partitions)
    row = rank_sum(df, "g", ["v"]).first()
    no = [v for _, g, v in GROUPED if g == "No"]
    yes = [v for _, g, v in GROUPED if g == "Yes"]
    w = sum((x > y) + 0.5 * (x == y) for x, y in itertools.product(no, yes))
    assert row["statistic"] == pytest.approx(w)
    n = len(no) + len(yes)
    ties = sum(k**3 - k for k in (sum(v == u for _, _, v in GROUPED) for u in {v for _, _, v in GROUPED}))
    sd = math.sqrt(len(no) * len(yes) / 12 * (n + 1 - ties / (n * (n - 1))))
    centred = w - len(no) * len(yes) / 2
    assert row["p_value"] == pytest.approx(math.erfc(abs((centred - math.copysign(0.5, centred)) / sd) / math.sqrt(2)))


def test_rank_sum_rejects_three_groups(spark):
    df = spark.createDataFrame([(str(i % 3), float(i)) for i in range(9)], "g string, v double")
    with pytest.raises(Exception, match="more than two values"):
        rank_sum(df, "g", ["v"]).collect()


def test_chi_square(spark):
    df = spark.createDataFrame(GROUPED, "c string, g string, v double")
    row = chi_square(df, "g", ["c"]).first()
    observed = {(c, g): sum(x[0] == c and x[1] == g for x in GROUPED) for c in "abc" for g in ("Yes", "No")}
    expected = {(c, g): sum(o for k, o in observed.items() if k[0] == c) * sum(o for k, o in observed.items() if k[1] == g) / 90 for c, g in observed}
    statistic = sum((observed[k] - expected[k]) ** 2 / expected[k] for k in observed)
    assert row["statistic"] == pytest.approx(statistic) and row["df"] == 2


def exact_p(table):
    """Probability of all tables with these margins that are no more likely than the observed one (two columns)."""
    rows = [sum(r) for r in table]
    first = sum(r[0] for r in table)
    total = sum(rows)

    def probability(xs):
        return math.prod(math.comb(n, x) for n, x in zip(rows, xs)) / math.comb(total, first)

    observed = probability([r[0] for r in table])
    cells = itertools.product(*[range(n + 1) for n in rows])
    return sum(q for xs in cells if sum(xs) == first and (q := probability(xs)) <= observed * (1 + 1e-7))


@pytest.mark.parametrize("table", [[(8, 2), (3, 9), (5, 5)], [(3, 1), (1, 4), (6, 6)]])
def test_permutation_test_approaches_the_exact_test(spark, table):
    rows = [(f"r{i}", f"c{j}") for i, r in enumerate(table) for j, n in enumerate(r) for _ in range(n)]
    df = spark.createDataFrame([*rows, (None, "c0"), ("r0", None)], "a string, b string")
    simulated = permutation_test(df, "a", "b", 4000, seed=3).first()
    assert simulated["replicates"] == 4000
    assert simulated["p_value"] == pytest.approx(exact_p(table), abs=0.03)
    assert permutation_test(df, "a", "b", 200, seed=3).first() == permutation_test(df, "a", "b", 200, seed=3).first()


RESULTS = ("predictor string, class string, term string, term_label string, term_number bigint, level string, level_number bigint, "
           "n_per_level bigint, n bigint, n_obs bigint, or double, or_ci_low double, or_ci_high double, wald_p_value double, anova_p_value double")


def results_frame(spark, name="pain_symptom_day"):
    return spark.createDataFrame(
        [
            ("(Intercept)", None, "(Intercept)", None, None, None, None, None, 9, 90, 0.5, 0.4, 0.6, 0.01, None),
            ("study_day", "numeric", "study_day", "study_day", 1, None, None, 90, 9, 90, 1.0, 0.9, 1.1, 0.02, 0.02),
            (name, "factor", f"{name}No", name, 2, "No", 1, 1050, 9, 90, None, None, None, None, 0.03),
            (name, "factor", f"{name}Yes", name, 2, "Yes", 2, 40, 9, 90, 1.5, 1.0, 2.25, 0.03, 0.03),
            ("nausea_symptom_day", "factor", "nausea_symptom_dayYes", "n", 2, "Yes", 2, 20, 9, 90, 2.0, 1.0, 4.0, 0.9, 0.9),
        ],
        RESULTS)


def test_results_table(spark):
    rows = {(r["predictor"], r["level"]): r for r in results_table(results_frame(spark), ["study_day"]).collect()}
    assert set(rows) == {("Pain", "No"), ("Pain", "Yes"), ("Nausea", "Yes")}
    assert (rows["Pain", "No"]["or_and_ci"], rows["Pain", "No"]["p_value"], rows["Pain", "No"]["q_value"]) == ("*Reference*", "", "")
    assert (rows["Pain", "Yes"]["or_and_ci"], rows["Pain", "Yes"]["p_value"], rows["Pain", "Yes"]["q_value"]) == ("1.50 (1.00, 2.25)", ".03", ".06")
    adjusted = results_table(results_frame(spark), adjusted=True, include_q=False, include_anova=True)
    assert adjusted.columns[-3:] == ["adjusted_or_and_ci", "adjusted_p_value", "adjusted_anova_p_value"]


def test_joined_tables(spark):
    table = individual_table(results_frame(spark), results_frame(spark)).collect()
    assert [(r["predictor"], r["level"], r["level_number"]) for r in table] == [
        ("Nausea", "Nausea", 0), ("Nausea", "Yes", 2), ("Pain", "Pain", 0), ("Pain", "No", 1), ("Pain", "Yes", 2)]
    assert table[4]["adjusted_q_value"] == ".06" and table[2]["p_value"] is None
    name = "number_of_significant_individual_symptoms_binned"
    counts = count_table(results_frame(spark, name), results_frame(spark, name)).collect()
    head = [r for r in counts if r["level_number"] == 0 and r["predictor"].startswith("Number")][0]
    assert (head["level"], head["p_value"], head["adjusted_p_value"]) == ("Number of symptoms", ".03", ".03")
    assert "anova_p_value" not in head.asDict()


def test_forest_frame(spark):
    rows = {r["term"]: r for r in forest_frame(results_frame(spark)).collect()}
    assert "(Intercept)" not in rows
    no, yes, day = rows["pain_symptom_dayNo"], rows["pain_symptom_dayYes"], rows["study_day"]
    assert (no["or"], no["conf_int"], no["p_value"], no["n_per_level"]) == (1.0, "Reference", "", "1,050")
    assert (yes["conf_int"], day["conf_int"], day["predictor"]) == ("1.50 (1.00-2.25)", "1.00 (0.90-1.10)", "Study day")


def test_rank_sum_without_spread(spark):
    from dayspan.operators.association import rank_sum

    rows = [("a", 1.0, 5.0, None), ("b", 2.0, 5.0, None), ("a", 3.0, 5.0, None), ("b", 4.0, 5.0, None)]
    df = spark.createDataFrame(rows, "g string, x double, same double, none double")
    got = {r["variable"]: r for r in rank_sum(df, "g", ["x", "same", "none"]).collect()}
    assert got["x"]["statistic"] is not None and got["x"]["p_value"] is not None
    assert got["same"]["statistic"] is None and got["same"]["p_value"] is None
    assert "none" not in got or got["none"]["p_value"] is None

"""Plans are built without running a job, and read their input as often as they say."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_points  # noqa: E402
from dayspan.operators.aggregates import summarize_columns  # noqa: E402
from dayspan.operators.joins import full_join, full_join_all  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
LAZY = ("individual_table event_characteristics run_end run_end_in_blocks fdr_adjusted fdr_adjusted_in_blocks rank_sum_by_group event_log "
        "merge_adjacent_events number_events_in_blocks neighbours_in_blocks fill_down_in_blocks categorize_visits_in_blocks count_table "
        "sample_characteristics compare_sample full_join_all merge_sources").split()

needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not present")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_tables
@pytest.mark.parametrize("name", LAZY)
def test_no_job_while_building(spark, name):
    context = spark.sparkContext
    build = entry_points.queries()[name]
    build(spark, SF_DIR)  # reading a schema from a file's footer is a job of its own, once
    context.setJobGroup(f"build {name}", "plan only")
    try:
        real = build(spark, SF_DIR)
        reads = [leaf for leaf in plan_of(real).split("\n") if "FileScan" in leaf]
        jobs = len(context.statusTracker().getJobIdsForGroup(f"build {name}"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    # Parquet footers are read by one task per opened table; nothing else may run.
    assert reads and jobs <= len(set(reads)) + 2, jobs


def sources(spark, n):
    return [spark.createDataFrame([(i, k * 10 + i) for i in range(k, k + 4)] + [(None, -k)], f"id int, v{k} int") for k in range(n)]


@pytest.mark.parametrize("n", [2, 3, 6])
def test_full_joins_read_each_source_twice(spark, n):
    frames = sources(spark, n)
    joined = full_join_all(frames, ["id"])
    assert plan_of(joined).count("Scan ExistingRDD") <= 2 * n
    want = frames[0]
    for frame in frames[1:]:
        want = full_join(want, frame, ["id"])
    assert sorted(map(str, joined.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_full_join_of_several_keys_with_nulls_and_repeats(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "x", 2), (None, "x", 3), (None, "x", 3), (2, None, 4)], "k int, l string, a int")
    b = spark.createDataFrame([(1, "x", 5), (None, "x", 6), (3, "y", 7)], "k int, l string, b int")
    c = spark.createDataFrame([(1, "x", 8), (1, "x", 9), (3, "y", 10), (2, None, 11)], "k int, l string, c int")
    got = sorted(map(str, (tuple(r) for r in full_join_all([a, b, c], ["k", "l"]).select("k", "l", "a", "b", "c").collect())))
    for f, name in ((a, "a"), (b, "b"), (c, "c")):
        f.createOrReplaceTempView(f"full_{name}")
    want = spark.sql("""SELECT coalesce(a.k, b.k, c.k), coalesce(a.l, b.l, c.l), a, b, c FROM full_a a FULL JOIN full_b b ON a.k = b.k AND a.l = b.l
        FULL JOIN full_c c ON coalesce(a.k, b.k) = c.k AND coalesce(a.l, b.l) = c.l""")
    assert got == sorted(map(str, (tuple(r) for r in want.collect())))


def test_restricted_full_join_reads_each_source_once(spark):
    frames = sources(spark, 4)
    within = spark.createDataFrame([(2,), (2,), (5,), (99,), (None,)], "id int")
    joined = full_join_all(frames, ["id"], within)
    assert plan_of(joined).count("Scan ExistingRDD") == 5
    rows = {r["id"]: r.asDict() for r in joined.collect()}
    assert sorted(rows) == [2, 5] and rows[2]["v1"] == 12 and rows[5]["v0"] is None and rows[5]["v3"] == 35


def test_continuous_summary_has_no_generator(spark):
    rows = [("a", 1.0, None), ("a", 3.0, 5.0), ("b", 10.0, None), (None, 2.0, 4.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    out = summarize_columns(df, ["x", "y"], by="g", add_overall=True)
    plan = plan_of(out)
    assert "Generate" not in plan and "Expand" not in plan
    got = {(r["variable"], r["stratum"]): (r["n"], r["n_missing"], r["mean"], r["sd"], r["min"], r["max"]) for r in out.collect()}
    plain = df.agg(F.count("x"), F.avg("x"), F.stddev_samp("x"), F.min("x"), F.max("x")).first()
    assert got["x", "Overall"] == (plain[0], 0, pytest.approx(plain[1]), pytest.approx(plain[2]), plain[3], plain[4])
    assert got["y", "b"] == (0, 1, None, None, None, None) and got["y", "a"] == (1, 1, 5.0, None, 5.0, 5.0)
    assert got["y", "Overall"][:3] == (2, 2, 4.5) and got["x", None] == (1, 0, 2.0, None, 2.0, 2.0)

"""Readers, sinks, header cleaning and the stage folder."""

import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dayspan.functions.parsing import assign_day
from dayspan.functions.ratings import severe_flag
from dayspan.operators.reshape import slots_to_long
from dayspan.operators.select import across
from dayspan.session import checkpoint_root, stage
from dayspan.sources.headers import clean_names, cleaned_names, drop_columns
from dayspan.sources.readers import pull_responses, read_clean, read_file, read_many, read_table
from dayspan.sources.sinks import write_stage


def test_cleaned_names():
    assert cleaned_names(["1. What is your age?", "a) Type (e.g., x, y)", "Record ID", "recordId", "% done", "2nd try", "12) Item", "Gender", "gender"]) == [
        "what_is_your_age", "type", "record_id", "record_id_2", "percent_done", "x2nd_try", "item", "gender", "gender_2"]


def test_cleaned_names_are_distinct_and_keep_letters():
    assert cleaned_names(["A", "a b", "a-b", "a_b_2"]) == ["a", "a_b", "a_b_2", "a_b_2_2"]
    assert cleaned_names(["Größe", "Âge", "a`b"]) == ["grosse", "age", "a_b"]


@given(st.lists(st.text(alphabet="aA b-_2é`", max_size=6), max_size=12))
def test_cleaned_names_are_always_distinct(names):
    got = cleaned_names(names)
    assert len(set(got)) == len(names) and all(re.fullmatch(r"[a-z][a-z0-9_]*", n) for n in got)


def test_names_may_differ_in_case_or_hold_backticks(spark):
    raw = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int").toDF("ID", "id", "a`b", "skip")
    df = clean_names(drop_columns(raw, ["skip"]))
    assert df.columns == ["id", "id_2", "a_b"] and tuple(df.first()) == (1, 2, 3)


def test_read_clean(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('Record ID,Repeat Instance,"1. Stage, now",skip\n1,9,NA,z\n2,9,,z\n3,9,"a ""b""",z\n')
    df = read_clean(spark, str(path), exclude_names=["skip", "absent"], exclude_patterns=["Repeat"])
    assert df.columns == ["record_id", "stage_now"]
    assert [tuple(r) for r in df.orderBy("record_id").collect()] == [("1", None), ("2", None), ("3", 'a "b"')]
    with pytest.raises(ValueError):
        read_clean(spark, "data.xlsx")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "x,y"), (2, 2.5, 'q"q')], "a int, b double, c string")
    for fmt in ("csv", "parquet", "json"):
        write_stage(df, str(tmp_path / fmt), fmt)
        write_stage(df, str(tmp_path / fmt), fmt)
        back = read_file(spark, str(tmp_path / fmt), fmt, "a int, b double, c string")
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    text = "\n".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert "1,NA," in text
    write_stage(df, str(tmp_path / "blank"), "csv", null_value="")
    assert "1,," in "\n".join(p.read_text() for p in (tmp_path / "blank").glob("*.csv"))
    write_stage(df.select("c"), str(tmp_path / "names"), "text")
    assert {r[0] for r in spark.read.text(str(tmp_path / "names")).collect()} == {"x,y", 'q"q'}
    with pytest.raises(ValueError):
        write_stage(df, str(tmp_path / "bad"), "text")
    with pytest.raises(ValueError):
        write_stage(df, str(tmp_path / "bad"), "xml")


def test_read_many_and_tables(spark, tmp_path):
    write_stage(spark.range(2).selectExpr("id", "'a' AS x"), str(tmp_path / "1"))
    write_stage(spark.range(1).selectExpr("id"), str(tmp_path / "2"))
    both = read_many(spark, [str(tmp_path / "1"), str(tmp_path / "2")], "parquet")
    assert sorted(tuple(r) for r in both.select("id", "x").collect() if r["x"]) == [(0, "a"), (1, "a")] and both.count() == 3
    spark.range(3).createOrReplaceTempView("three")
    assert read_table(spark, "three").count() == 3


def test_pull_responses(spark):
    df = spark.createDataFrame([("0015",), ("1002",), ("unknown",), ("",), (None,), ("abc",)], "id string")
    assert sorted(r["record_id"] for r in pull_responses(df, {"0015": "1015"}).collect()) == ["1002", "1015", "abc"]
    assert sorted(r["record_id"] for r in pull_responses(df, {"0015": "1015"}, ids=range(1001, 1184)).collect()) == ["1002", "1015"]
    assert [r["record_id"] for r in pull_responses(df, {}, ids=["abc"]).collect()] == ["abc"]


def test_filters_reach_the_scan(spark, tmp_path):
    write_stage(spark.range(100).selectExpr("cast(id as string) id", "id x", "id y"), str(tmp_path / "t"))
    plan = pull_responses(read_table(spark, str(tmp_path / "t"), "parquet"), {}).select("record_id")._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(id)" in plan and "ReadSchema: struct<id:string>" in plan


class NamedFolder:
    """Stands in for a session on a cluster."""

    def __init__(self, configured=None, current=None, master="spark://host:7077"):
        self.conf = {"spark.checkpoint.dir": configured}
        self.sparkContext = self
        self.master = master
        self.getCheckpointDir = lambda: current


def test_stage_folder_is_the_one_the_cluster_names():
    assert checkpoint_root(NamedFolder("hdfs://shared/cp")) == "hdfs://shared/cp"
    assert checkpoint_root(NamedFolder(current="s3a://bucket/cp")) == "s3a://bucket/cp"
    with pytest.raises(RuntimeError):
        checkpoint_root(NamedFolder())


def test_stage_keeps_rows_and_pruning(spark):
    staged = stage(spark.range(5).withColumn("d", F.lit("x")), "t")
    assert staged.inputFiles()[0].split("/dayspan/")[0].endswith(checkpoint_root(spark).removeprefix("file:"))
    assert staged.count() == 5
    assert "ReadSchema: struct<id:bigint>" in staged.select("id")._jdf.queryExecution().executedPlan().toString()


def test_stateless_operators_accept_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, 3.0, 1.0, "2024-01-02 01:00:00")], "id int, hosp1_x double, hosp2_x double, t string")
    write_stage(rows, str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    flagged = across(stream, ["hosp1_x"], severe_flag, lambda c: f"{c}_flag")
    long = slots_to_long(flagged, ["id", "hosp1_x_flag", "t"], "hosp(.)_(x)").withColumn(
        "day", assign_day(F.col("t").cast("timestamp_ntz"), day_end="02:00:00"))
    query = long.writeStream.format("memory").queryName("long_slots").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(60)
    got = spark.sql("SELECT slot, x, hosp1_x_flag, cast(day AS string) AS day FROM long_slots").collect()
    assert sorted(map(tuple, got)) == [("1", 3.0, 1, "2024-01-01"), ("2", 1.0, 1, "2024-01-01")]


def test_names_in_any_script():
    assert cleaned_names(["Æther", "Øre", "Łódź", "Straße", "ÞORN", "имя", "имя", "年龄 (years)", "naïve Café", "Ελλ 1"]) == [
        "aether", "ore", "lodz", "strasse", "thorn", "u0438u043cu044f", "u0438u043cu044f_2", "u5e74u9f84_years", "naive_cafe", "u0395u03bbu03bb_1"]


def test_types_come_from_all_values(spark):
    from dayspan.sources.readers import typed_columns

    names = ["i", "d", "e", "day", "at", "flag", "code", "mixed", "none", "blank", "a`b", "late"]
    rows = [("1", "1", "1e3", "2024-01-02", "2024-01-02 10:00:00", "true", "007", "1", None, "", "5", "3")] * 500
    rows.append((" -20 ", "2.5", ".5", "2024-1-3", "2024-01-03T11:30:00.5", "F", "008", "x", None, None, None, "3x"))
    out = typed_columns(spark.createDataFrame(rows, ", ".join(f"`{n.replace('`', '``')}` string" for n in names)).repartition(5))
    assert out.dtypes == list(zip(names, ["bigint", "double", "double", "date", "timestamp_ntz", "boolean", "string", "string", "string", "string", "bigint", "string"]))
    last = [r for r in out.collect() if r["i"] == -20]
    assert len(last) == 1 and last[0]["d"] == 2.5 and last[0]["e"] == 0.5 and str(last[0]["day"]) == "2024-01-03" and last[0]["flag"] is False
    assert typed_columns(spark.createDataFrame([], "a string, b int")).dtypes == [("a", "string"), ("b", "int")]

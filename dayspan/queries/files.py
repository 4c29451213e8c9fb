"""Readers and sinks: tables are written to the shared folder, read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayspan.queries import frames as fr
from dayspan.queries.registry import query
from dayspan.session import new_stage_path
from dayspan.sources.readers import pull_responses, read_clean, read_file, read_many, read_table
from dayspan.sources.sinks import write_stage


@query("clean_csv_headers", """SELECT CAST(c_custkey AS VARCHAR) AS customer_key, c_mktsegment AS market_segment, CAST(c_nationkey AS VARCHAR) AS nation,
  CAST(c_nationkey % 5 AS VARCHAR) AS nation_2 FROM customer""")
def q_clean_csv(spark, sf_dir):
    """Numbered headers with examples and repeated names, written as CSV and read with cleaned names."""
    customer = fr.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("1. Customer Key"),
        F.col("c_mktsegment").alias("a) Market Segment (e.g., building)"),
        F.col("c_nationkey").alias("Nation"),
        (F.col("c_nationkey") % 5).alias("2) nation"),
        F.lit(1).alias("Repeat Instance"),
        F.col("c_name").alias("unused"),
    )
    path = new_stage_path(spark, "headers")
    write_stage(customer, path, "csv")
    return read_clean(spark, path, "csv", exclude_names=["unused", "absent"], exclude_patterns=["Repeat"])


@query("typed_csv", """SELECT o_orderkey AS ordrenummer, o_totalprice AS aerlig_pris, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS oere_dag,
  o_orderstatus AS lodz, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS u0438u043cu044f, lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS code,
  o_orderkey % 2 = 0 AS even, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE CAST(o_custkey AS VARCHAR) END AS mixed FROM orders""")
def q_typed_csv(spark, sf_dir):
    """Headers in other letters and scripts; the types come from all values."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    orders = fr.table(spark, sf_dir, "orders").select(
        key.alias("Ordrenummer"), F.col("o_totalprice").alias("Ærlig pris"), F.col("o_orderdate").cast("date").alias("Œre Dag"),
        F.col("o_orderstatus").alias("Łódź"), F.when(key % 7 != 0, customer).alias("имя"), F.lpad(customer.cast("string"), 9, "0").alias("code"),
        (key % 2 == 0).alias("even"), F.when(key % 5 == 0, "unknown").otherwise(customer.cast("string")).alias("mixed"),
    )
    path = new_stage_path(spark, "typed")
    write_stage(orders, path, "csv")
    return read_clean(spark, path, "csv", infer=True)


@query("csv_with_schema_and_nulls", """SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS priority, round(o_totalprice, 6) AS total,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders""")
def q_csv_nulls(spark, sf_dir):
    orders = fr.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"), F.col("o_totalprice").alias("total"),
        F.col("o_orderdate").cast("date").alias("day"),
    )
    path = new_stage_path(spark, "nulls")
    write_stage(orders, path, "csv")
    return read_file(spark, path, "csv", "o_orderkey bigint, priority string, total double, day date")


@query("name_list_sink", "SELECT DISTINCT p_name AS value FROM part")
def q_name_list(spark, sf_dir):
    path = new_stage_path(spark, "names")
    write_stage(fr.table(spark, sf_dir, "part").select("p_name").distinct(), path, "text")
    return spark.read.text(path)


@query("read_many", "SELECT p_partkey, p_brand, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size AS BIGINT) END AS p_size FROM part")
def q_read_many(spark, sf_dir):
    """The table in three files, one of which lacks a column."""
    part = fr.table(spark, sf_dir, "part")
    paths = []
    for third in range(3):
        rows = part.filter(F.col("p_partkey") % 3 == third).select("p_partkey", "p_brand", "p_size")
        paths.append(new_stage_path(spark, "third"))
        write_stage(rows if third else rows.drop("p_size"), paths[-1])
    return read_many(spark, paths, "parquet")


@query("read_table", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def q_read_table(spark, sf_dir):
    return read_table(spark, f"{sf_dir}/nation.parquet", "parquet").select("n_nationkey", "n_name")


@query("pull_responses", """SELECT event_id, CASE WHEN user_id = 15 THEN '1015' ELSE CAST(user_id AS VARCHAR) END AS record_id FROM events
WHERE user_id NOT IN (3, 4, 5) AND user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20 UNION ALL SELECT 1015)
  AND (user_id <> 15)
UNION ALL SELECT event_id, '1015' FROM events WHERE user_id = 15""")
def q_pull(spark, sf_dir):
    user = F.col("user_id")
    rows = fr.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(user == 3, "unknown").when(user == 4, "").when(user == 5, None).when(user == 15, "0015")
        .otherwise(user.cast("string")).alias("id"),
    )
    ids = fr.table(spark, sf_dir, "customer").filter("c_nationkey < 20").select(F.col("c_custkey").cast("string").alias("id"))
    ids = ids.unionByName(spark.createDataFrame([("1015",)], "id string"))
    return pull_responses(rows, {"0015": "1015"}, ids=ids).drop("id")

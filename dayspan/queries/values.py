"""Column functions applied to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayspan.functions.dates import calendar_year, days_between, whole_months
from dayspan.functions.labels import (
    format_or,
    format_p,
    interval_text,
    n_percent,
    name_from_text,
    predictor_from_term,
    predictor_label,
    rating_label,
    replace_first_chain,
    thousands,
    variable_label,
)
from dayspan.functions.levels import level_number, recode, with_levels
from dayspan.functions.parsing import assign_day, parse_mdy, to_datetime, to_number
from dayspan.functions.ratings import (
    bin_top,
    count_known,
    if_else,
    in_set,
    matches,
    rating_text,
    row_max_by_stem,
    severe_flag,
    yes_no,
)
from dayspan.operators.select import decision_flag
from dayspan.plans.analysis import count_selected
from dayspan.plans.responses import column_name_mapping
from dayspan.queries import frames as fr
from dayspan.queries.registry import query


def table(spark, sf_dir, name):
    return fr.table(spark, sf_dir, name)


@query("text_to_number", """SELECT p_partkey, TRY_CAST(split_part(p_brand, '#', 2) AS DOUBLE) AS brand_number,
  TRY_CAST(CASE WHEN p_size % 5 = 0 THEN 'n/a' ELSE ' ' || p_size || ' ' END AS DOUBLE) AS size_number FROM part""")
def q_to_number(spark, sf_dir):
    padded = F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" "))
    return table(spark, sf_dir, "part").select(
        "p_partkey", to_number(F.split_part("p_brand", F.lit("#"), F.lit(2))).alias("brand_number"),
        to_number(F.when(F.col("p_size") % 5 == 0, "n/a").otherwise(padded)).alias("size_number"),
    )


@query("text_to_datetime", """SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS moment,
  CASE WHEN event_id % 4 <> 0 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS partial FROM events""")
def q_to_datetime(spark, sf_dir):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf_dir, "events").select(
        "event_id", to_datetime(text).alias("moment"),
        to_datetime(F.when(F.col("event_id") % 4 == 0, "soon").otherwise(text)).alias("partial"),
    )


@query("parse_month_day_year", """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 9 = 0 THEN NULL
  ELSE CAST(o_orderdate AS DATE) END AS VARCHAR) AS day FROM orders""")
def q_mdy(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 9 == 0, "unknown").otherwise(F.date_format("o_orderdate", "MM/dd/yy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", parse_mdy(text).alias("day"))


@query("assign_day_shifted", """SELECT event_id, CAST(CASE WHEN strftime(ts, '%H:%M:%S') > '00:00:00' AND strftime(ts, '%H:%M:%S') < '04:30:00'
  THEN CAST(ts AS DATE) - 1 ELSE CAST(ts AS DATE) END AS VARCHAR) AS day, CAST(CAST(ts AS DATE) AS VARCHAR) AS own_day FROM events""")
def q_assign(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", assign_day(F.col("ts"), "00:00:00", "04:30:00").alias("day"), assign_day(F.col("ts")).alias("own_day")
    )


@query("count_known", """SELECT o_orderkey, CAST((CASE WHEN o_orderpriority <> '5-LOW' THEN 1 ELSE 0 END) + (CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END) AS BIGINT) AS known FROM orders""")
def q_known(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("a"), F.nullif("o_orderstatus", F.lit("F")).alias("b")
    )
    return rows.select("o_orderkey", count_known(["a", "b"]).alias("known"))


LINE_RATINGS = """(SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN l_quantity < 40 THEN l_quantity % 5 END AS pain_sev,
  CASE WHEN l_discount > 0.03 THEN l_linenumber % 5 END AS pain_freq,
  CASE WHEN l_tax > 0.02 THEN CAST(l_orderkey % 5 AS DOUBLE) END AS pain_abdomen_sev FROM lineitem)"""


def line_ratings(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_quantity") < 40, F.col("l_quantity") % 5).alias("pain_sev"),
        F.when(F.col("l_discount") > 0.03, F.col("l_linenumber") % 5).cast("double").alias("pain_freq"),
        F.when(F.col("l_tax") > 0.02, F.col("l_orderkey") % 5).cast("double").alias("pain_abdomen_sev"),
    )


RATING_COLUMNS = ["pain_sev", "pain_freq", "pain_abdomen_sev"]


@query("row_max_by_stem", f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, greatest(pain_sev, pain_freq) AS pain, pain_abdomen_sev AS pain_abdomen FROM {LINE_RATINGS}")
def q_row_max(spark, sf_dir):
    best = row_max_by_stem(RATING_COLUMNS)
    return line_ratings(spark, sf_dir).select("l_orderkey", "l_linenumber", *[c.alias(s) for s, c in best.items()])


@query("row_max_by_stem_substring", f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, greatest(pain_sev, pain_freq, pain_abdomen_sev) AS pain, pain_abdomen_sev AS pain_abdomen FROM {LINE_RATINGS}")
def q_row_max_substring(spark, sf_dir):
    best = row_max_by_stem(RATING_COLUMNS, match="substring")
    return line_ratings(spark, sf_dir).select("l_orderkey", "l_linenumber", *[c.alias(s) for s, c in best.items()])


@query("severe_flag", f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(CASE WHEN pain_sev IN (2, 3, 4) THEN 1 ELSE 0 END AS BIGINT) AS flag FROM {LINE_RATINGS}""")
def q_severe(spark, sf_dir):
    return line_ratings(spark, sf_dir).select("l_orderkey", "l_linenumber", severe_flag(F.col("pain_sev")).alias("flag"))


@query("yes_no_text", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' END AS answer FROM orders")
def q_yes_no(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", yes_no(F.col("o_orderkey") % 3).alias("answer"))


@query("count_selected", f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST((CASE WHEN pain_sev IN (2, 3, 4) THEN 1 ELSE 0 END)
  + CASE WHEN pain_abdomen_sev IS NOT NULL THEN CASE WHEN pain_abdomen_sev IN (2, 3, 4) THEN 1 ELSE 0 END END AS BIGINT) AS number_of_flags FROM {LINE_RATINGS}""")
def q_count_selected(spark, sf_dir):
    flags = line_ratings(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", severe_flag(F.col("pain_sev")).alias("a"), severe_flag(F.col("pain_freq")).alias("b"),
        F.when(F.col("pain_abdomen_sev").isNotNull(), severe_flag(F.col("pain_abdomen_sev"))).alias("c"),
    )
    chosen = table(spark, sf_dir, "region").select(
        F.when(F.col("r_regionkey") == 0, "a").when(F.col("r_regionkey") == 1, "c").otherwise(F.col("r_name")).alias("name")
    )
    return count_selected(flags, chosen, ["a", "b", "c"], "number_of_flags").drop("a", "b", "c")


@query("bin_with_open_top", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN l_linenumber >= 4 THEN '4+' ELSE CAST(l_linenumber AS VARCHAR) END AS binned,
  CASE WHEN l_quantity >= 30 THEN 'Unknown' WHEN l_quantity >= 5 THEN '5+' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS named FROM lineitem""")
def q_bin(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", bin_top(F.col("l_linenumber"), 4).alias("binned"),
        bin_top(F.when(F.col("l_quantity") < 30, F.col("l_quantity")), 5, "Unknown").alias("named"),
    )


@query("rating_text", f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN pain_sev IS NULL THEN 'Unknown' WHEN pain_sev IN (-1, 0) THEN 'Not endorsed or 0'
  ELSE CAST(CAST(pain_sev AS BIGINT) AS VARCHAR) END AS rating FROM {LINE_RATINGS}""")
def q_rating_text(spark, sf_dir):
    return line_ratings(spark, sf_dir).select("l_orderkey", "l_linenumber", rating_text(F.col("pain_sev")).alias("rating"))


@query("if_else_with_nulls", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_totalprice > 100000 AND o_orderstatus <> 'F' THEN 'high' ELSE 'low' END AS size,
  CAST(CASE WHEN o_orderstatus <> 'F' AND o_orderstatus IN ('O') THEN 1 ELSE 0 END AS BIGINT) AS is_open,
  CAST(CASE WHEN o_orderstatus <> 'F' AND regexp_matches(o_orderstatus, '^P') THEN 1 ELSE 0 END AS BIGINT) AS is_partial FROM orders""")
def q_if_else(spark, sf_dir):
    status = F.nullif("o_orderstatus", F.lit("F"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", if_else(F.when(status.isNotNull(), F.col("o_totalprice") > 100000), "high", "low").alias("size"),
        in_set(status, ["O"]).cast("int").alias("is_open"), matches(status, "^P").cast("int").alias("is_partial"),
    )


@query("decision_flag", f"""WITH {fr.ENCOUNTERS_SQL}
SELECT event_id, CAST(CASE WHEN include_yes_no LIKE 'yes%' THEN 1 WHEN include_yes_no LIKE 'no%' THEN 0 END AS BIGINT) AS include FROM encounters""")
def q_decision(spark, sf_dir):
    return fr.encounters(spark, sf_dir).select("event_id", decision_flag(F.col("include_yes_no")).alias("include"))


@query("days_between", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(CAST(l_shipdate AS DATE) - DATE '1998-01-15' AS BIGINT) AS days FROM lineitem")
def q_days(spark, sf_dir):
    start = F.lit("1998-01-15").cast("date")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", days_between(F.col("l_shipdate").cast("date"), start).alias("days")
    )


@query("whole_months", """SELECT o_orderkey, CAST(12 * (year(o_orderdate) - 2000) + month(o_orderdate) - 1 - CASE WHEN day(o_orderdate) < 31 THEN 1 ELSE 0 END AS BIGINT) AS months FROM orders""")
def q_months(spark, sf_dir):
    start = F.lit("2000-01-31").cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", whole_months(start, F.col("o_orderdate")).alias("months"))


@query("calendar_year", "SELECT o_orderkey, year(o_orderdate) AS visit_year FROM orders")
def q_year(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", calendar_year(F.col("o_orderdate")).alias("visit_year"))


@query("recode_values", """SELECT c_custkey, coalesce(CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'HOME' WHEN 'AUTOMOBILE' THEN 'CAR' WHEN 'MACHINERY' THEN NULL ELSE c_mktsegment END, 'Unknown') AS segment FROM customer""")
def q_recode(spark, sf_dir):
    segment = F.nullif("c_mktsegment", F.lit("MACHINERY"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", recode(segment, {"HOUSEHOLD": "HOME", "AUTOMOBILE": "CAR"}, "Unknown").alias("segment")
    )


@query("with_levels", """SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN c_mktsegment END AS segment,
  CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 END AS BIGINT) AS segment_number FROM customer""")
def q_with_levels(spark, sf_dir):
    levels = ["BUILDING", "FURNITURE"]
    return table(spark, sf_dir, "customer").select(
        "c_custkey", with_levels(F.col("c_mktsegment"), levels).alias("segment"),
        level_number(F.col("c_mktsegment"), levels).alias("segment_number"),
    )


@query("name_from_text", """SELECT p_partkey, replace(CASE WHEN p_name LIKE 'small %' THEN 'diarrhea' ELSE lower(p_name) END, ' ', '_') AS name FROM part""")
def q_name_from_text(spark, sf_dir):
    name = F.col("p_name")
    wording = F.concat(F.initcap(name), F.lit(" (e.g., "), F.col("p_type"), F.lit("), any"))
    asked = F.when(name.startswith("small "), F.concat(F.lit("Diarrhea of "), name)).otherwise(wording)
    return table(spark, sf_dir, "part").select("p_partkey", name_from_text(asked).alias("name"))


@query("item_name_chain", """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'nausea_' WHEN 1 THEN 'pain_in_the_abdomen_' WHEN 2 THEN 'problems_with_memory_' ELSE 'decreased_appetite_app_' END
  || CASE WHEN p_partkey % 2 = 0 THEN 'sev' ELSE 'freq' END AS name FROM part""")
def q_item_chain(spark, sf_dir):
    stem = F.element_at(F.array(*[F.lit(x) for x in ("d_naus_", "d_painabd_", "d_mem_", "d_app_app_")]), F.col("p_size") % 4 + 1)
    item = F.concat(stem, F.when(F.col("p_partkey") % 2 == 0, "sev").otherwise("freq"))
    return table(spark, sf_dir, "part").select("p_partkey", replace_first_chain(item).alias("name"))


@query("column_name_mapping", """SELECT 'd_symptoms_' || p_partkey AS current_column_name, replace(lower(p_name), ' ', '_') AS new_column_name FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT DISTINCT 'd_naus_' || p_size, 'nausea_' || p_size FROM part WHERE p_partkey % 2 = 1""")
def q_mapping(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    even = F.col("p_partkey") % 2 == 0
    metadata = part.select(
        F.when(even, F.concat(F.lit("d_symptoms_"), F.col("p_partkey").cast("string")))
        .otherwise(F.concat(F.lit("d_naus_"), F.col("p_size").cast("string"))).alias("question_id"),
        F.concat(F.initcap("p_name"), F.lit(", of any kind")).alias("response_text_val"),
    )
    return column_name_mapping(metadata)


@query("predictor_label", "SELECT p_partkey, upper(p_name[1]) || substr(p_name, 2) AS label FROM part")
def q_predictor_label(spark, sf_dir):
    name = F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_symptom_day"))
    return table(spark, sf_dir, "part").select("p_partkey", predictor_label(name).alias("label"))


@query("rating_label", "SELECT p_partkey, upper(p_name[1]) || substr(p_name, 2) AS label FROM part")
def q_rating_label(spark, sf_dir):
    name = F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_highest_rating"))
    return table(spark, sf_dir, "part").select("p_partkey", rating_label(name).alias("label"))


@query("variable_label", """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Age (years, centered at mean)' WHEN 1 THEN 'PROMIS, PROPr'
  ELSE upper(p_name[1]) || substr(p_name, 2) END AS label FROM part""")
def q_variable_label(spark, sf_dir):
    name = F.when(F.col("p_size") % 3 == 0, "age_years_collapsed").when(F.col("p_size") % 3 == 1, "x_promis_preference_propr").otherwise(
        F.regexp_replace("p_name", " ", "_")
    )
    labelled = F.when(F.col("p_size") % 3 == 1, F.regexp_replace(variable_label(name), "^X ", "")).otherwise(variable_label(name))
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(labelled, ",  +", ", ").alias("label"))


@query("predictor_from_term", """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'pain_symptom_day' WHEN 1 THEN '(Intercept)' ELSE 'number_binned' END AS predictor FROM part""")
def q_from_term(spark, sf_dir):
    size = F.col("p_size") % 3
    term = F.when(size == 0, "pain_symptom_dayYes").when(size == 1, "(Intercept)").when(
        F.col("p_partkey") % 2 == 0, "number_binned4+"
    ).otherwise("number_binned2")
    return table(spark, sf_dir, "part").select("p_partkey", predictor_from_term(term).alias("predictor"))


@query("format_p_value", """WITH v AS (SELECT o_orderkey, (o_orderkey % 10007 + 0.25) / 10007 AS p FROM orders)
SELECT o_orderkey, CASE WHEN p < 0.001 THEN '<.001'
  WHEN p < 0.01 OR (p < 0.05 AND round(p, 2) = 0.05) THEN rtrim(ltrim(format('{:.3f}', p), '0'), '0')
  WHEN round(p, 2) = 1.0 THEN '>.99' ELSE ltrim(format('{:.2f}', p), '0') END AS text FROM v""")
def q_format_p(spark, sf_dir):
    p = (F.col("o_orderkey") % 10007 + 0.25) / 10007
    return table(spark, sf_dir, "orders").select("o_orderkey", format_p(p).alias("text"))


@query("format_odds_ratio", """SELECT o_orderkey, format('{:.2f}', v) AS text, format('{:.2f}', v) || ' (' || format('{:.2f}', v / 2) || ', ' || format('{:.2f}', v * 2) || ')' AS interval
FROM (SELECT o_orderkey, (o_orderkey % 1000 + 0.126) / 37.0 AS v FROM orders)""")
def q_format_or(spark, sf_dir):
    v = (F.col("o_orderkey") % 1000 + 0.126) / 37.0
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", format_or(v).alias("text"), interval_text(v, v / 2, v * 2).alias("interval")
    )


@query("count_and_percent_text", """WITH c AS (SELECT c_nationkey, count(*) * 997 AS n, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS b, count(*) AS t FROM customer GROUP BY 1)
SELECT c_nationkey::BIGINT AS c_nationkey, format('{:,}', n) AS n_text,
  format('{:,}', n) || ' (' || rtrim(rtrim(format('{:.2f}', round(CAST(b AS DOUBLE) / t * 100, 2)), '0'), '.') || '%)' AS n_percent FROM c""")
def q_n_percent(spark, sf_dir):
    counted = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("t"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("b")
    )
    n = F.col("t") * 997
    percent = F.round(F.col("b") / F.col("t") * 100, 2)
    return counted.select("c_nationkey", thousands(n).alias("n_text"), n_percent(n, percent).alias("n_percent"))


@query("constant_columns", "SELECT s_suppkey, 'ED' AS visit_type, '' AS notes FROM supplier")
def q_constant(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey").withColumns({"visit_type": F.lit("ED"), "notes": F.lit("")})

"""Selection, joins, reshaping, counts and ordered operators on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayspan.operators.aggregates import (
    cluster_counts,
    collapse_events,
    collapse_rare,
    freq,
    freq_with_share,
    level_counts,
    summarize_categorical,
    summarize_columns,
    summarize_continuous,
)
from dayspan.operators.association import compare_groups, permutation_test
from dayspan.operators.joins import exists_flag, full_join, full_join_all, left_join_all, null_safe_join
from dayspan.operators.reshape import (
    append_rows,
    bind_constants,
    melt_ratings,
    pivot_counts,
    slots_to_long,
    with_header_rows,
)
from dayspan.operators.select import (
    across,
    cols_like,
    complete_cases,
    decision_split,
    fill_nulls,
    mapping_from_frame,
    null_if,
    relocate,
    rename_by_mapping,
    select_significant,
    subset_ids,
)
from dayspan.operators.windows import (
    dedupe_first_best,
    event_within,
    fdr_bh,
    fill_down,
    fill_up,
    neighbours,
    next_value,
    number_rows,
    run_end,
)
from dayspan.plans.cohort import compare_sample, merge_sources, sample_characteristics, time_since
from dayspan.plans.labels import label_with_unknowns
from dayspan.queries import frames as fr
from dayspan.queries.cohort import SLOTS_SQL, model_rows, wide_slots
from dayspan.queries.registry import query

# Selection


@query("subset_ids_range", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 1001 AND 1183")
def q_subset_range(spark, sf_dir):
    return subset_ids(fr.table(spark, sf_dir, "orders"), "o_custkey", range(1001, 1184)).select("o_orderkey", "o_custkey")


@query("subset_ids_include", """SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def q_subset_include(spark, sf_dir):
    ids = fr.table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    return subset_ids(fr.table(spark, sf_dir, "orders"), "o_custkey", ids).select("o_orderkey", "o_custkey")


@query("subset_ids_exclude", """SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey END AS id FROM orders
WHERE o_orderkey % 9 = 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def q_subset_exclude(spark, sf_dir):
    """A null id is in no set, so it stays."""
    ids = fr.table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = fr.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey")).alias("id")
    )
    return subset_ids(orders, "id", ids, include=False)


@query("columns_by_pattern", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_discount, l_tax, l_shipdate::VARCHAR AS l_shipdate FROM lineitem")
def q_cols_like(spark, sf_dir):
    lines = fr.table(spark, sf_dir, "lineitem")
    picked = cols_like(lines, ends="KEY", contains="order") + cols_like(lines, contains="number")
    picked += cols_like(lines, starts="l_d") + cols_like(lines, regex="^l_tax$|ship")
    return lines.select(*picked)


@query("rename_by_mapping", """SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS total FROM orders""")
def q_rename(spark, sf_dir):
    names = {"o_orderkey": "order_id", "o_custkey": "customer_id", "o_totalprice": "total"}
    return rename_by_mapping(fr.table(spark, sf_dir, "orders").select(*names), names)


@query("rename_by_mapping_table", """SELECT p_partkey, CAST(p_size AS BIGINT) AS size, p_type AS type FROM part""")
def q_rename_table(spark, sf_dir):
    """The mapping is itself a table with one row per item name; it is read for the present columns only."""
    part = fr.table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type")
    items = fr.table(spark, sf_dir, "part").select(
        F.when(F.col("p_partkey") % 2 == 0, "p_size").otherwise("p_type").alias("current_column_name")
    ).distinct()
    mapping = items.withColumn("new_column_name", F.regexp_replace("current_column_name", "^p_", ""))
    return rename_by_mapping(part, mapping_from_frame(mapping, part.columns))


@query("across_columns", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(l_quantity * 2, 6) AS l_quantity_doubled,
  round(l_tax * 2, 6) AS l_tax_doubled FROM lineitem""")
def q_across(spark, sf_dir):
    lines = fr.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    doubled = across(lines, ["l_quantity", "l_tax"], lambda c: c * 2, lambda c: f"{c}_doubled")
    return doubled.drop("l_quantity", "l_tax")


DECISION_SQL = f"""WITH {fr.ENCOUNTERS_SQL}
SELECT event_id, include_yes_no, CAST({{flag}} AS BIGINT) AS include FROM encounters WHERE include_yes_no LIKE '{{start}}%'"""


@query("decision_included", DECISION_SQL.format(flag=1, start="yes"))
def q_included(spark, sf_dir):
    rows = fr.encounters(spark, sf_dir).select("event_id", "include_yes_no")
    return decision_split(rows, "include_yes_no")[0]


@query("decision_dropped", DECISION_SQL.format(flag=0, start="no"))
def q_dropped(spark, sf_dir):
    rows = fr.encounters(spark, sf_dir).select("event_id", "include_yes_no")
    return decision_split(rows, "include_yes_no")[1]


@query("null_if", """SELECT c_custkey, nullif(c_mktsegment, 'MACHINERY') AS c_mktsegment FROM customer""")
def q_null_if(spark, sf_dir):
    return null_if(fr.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], "MACHINERY")


@query("complete_cases", """SELECT c_custkey, c_mktsegment, round(c_acctbal, 6) AS c_acctbal FROM customer
WHERE c_mktsegment <> 'MACHINERY' AND c_acctbal >= 0""")
def q_complete(spark, sf_dir):
    rows = fr.table(spark, sf_dir, "customer").select(
        "c_custkey", F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("c_mktsegment"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"),
    )
    return complete_cases(rows)


@query("select_significant", """WITH results AS (
  SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'pain_symptom_day' WHEN '2-HIGH' THEN 'nausea_symptom_day' ELSE o_orderpriority END AS predictor,
    sum(o_orderkey % 7) / sum(o_orderkey % 5) AS odds, min(o_totalprice) / max(o_totalprice) AS p
  FROM orders GROUP BY o_orderpriority)
SELECT DISTINCT predictor FROM results WHERE regexp_matches(predictor, '.') AND odds >= 1 AND p < 0.1""")
def q_significant(spark, sf_dir):
    return select_significant(model_rows(spark, sf_dir), regex=".")


@query("fill_nulls", """SELECT o_orderkey, CAST(coalesce(CASE WHEN o_orderkey % 4 = 1 THEN 1 END, 0) AS BIGINT) AS flag,
  CAST(coalesce(CASE WHEN o_orderkey % 3 = 1 THEN 2 END, 0) AS BIGINT) AS other FROM orders""")
def q_fill(spark, sf_dir):
    orders = fr.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 4 == 1, 1).alias("flag"),
        F.when(F.col("o_orderkey") % 3 == 1, 2).alias("other"),
    )
    return fill_nulls(orders, ["flag", "other"], 0)


@query("distinct_rows", "SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders")
def q_distinct(spark, sf_dir):
    return fr.table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority").distinct()


@query("relocate_column", "SELECT s_suppkey, s_nationkey::BIGINT AS s_nationkey, s_name FROM supplier")
def q_relocate(spark, sf_dir):
    return relocate(fr.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), "s_nationkey", "s_suppkey")


# Joins

CUSTOMER_A = "(SELECT c_custkey AS id, c_acctbal FROM customer)"
PART_B = "(SELECT p_partkey + 50 AS id, p_brand FROM part)"


def two_sides(spark, sf_dir):
    """Two whole tables whose numbers overlap in part."""
    return (
        fr.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal"),
        fr.table(spark, sf_dir, "part").select((F.col("p_partkey") + 50).alias("id"), "p_brand"),
    )


FULL_SQL = f"SELECT coalesce(a.id, b.id) AS id, a.c_acctbal, b.p_brand FROM {CUSTOMER_A} a FULL JOIN {PART_B} b ON a.id = b.id"


@query("full_join", FULL_SQL)
def q_full_join(spark, sf_dir):
    return full_join(*two_sides(spark, sf_dir), ["id"])


@query("full_join_from_parts", FULL_SQL)
def q_full_join_parts(spark, sf_dir):
    """The way of every full join: a left join and an anti join, both of which AQE can split."""
    return full_join(*two_sides(spark, sf_dir), ["id"])


@query("full_join_all", f"""SELECT coalesce(a.id, b.id, c.id) AS id, a.c_acctbal, b.p_brand, c.n_orders
FROM {CUSTOMER_A} a FULL JOIN {PART_B} b ON a.id = b.id
FULL JOIN (SELECT o_custkey AS id, count(*) AS n_orders FROM orders GROUP BY 1) c ON coalesce(a.id, b.id) = c.id""")
def q_full_join_all(spark, sf_dir):
    counts = freq(fr.table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "id"), ["id"], "n_orders")
    return full_join_all([*two_sides(spark, sf_dir), counts], ["id"])


@query("merge_sources", f"""SELECT coalesce(a.id, b.id, c.id) AS id, a.c_acctbal, b.p_brand, c.n_orders
FROM {CUSTOMER_A} a FULL JOIN {PART_B} b ON a.id = b.id
FULL JOIN (SELECT o_custkey AS id, count(*) AS n_orders FROM orders GROUP BY 1) c ON coalesce(a.id, b.id) = c.id
WHERE coalesce(a.id, b.id, c.id) IN (SELECT user_id FROM events)""")
def q_merge_sources(spark, sf_dir):
    counts = freq(fr.table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "id"), ["id"], "n_orders")
    ids = fr.table(spark, sf_dir, "events").select("user_id")
    return merge_sources([*two_sides(spark, sf_dir), counts], "id", ids)


@query("inner_join_events_panel", f"""WITH {fr.PANEL_SQL}
SELECT event_id, record_id, CAST(date AS VARCHAR) AS date, study_day FROM panel
JOIN (SELECT event_id, user_id, CAST(ts AS DATE) AS d FROM events) e ON e.user_id = record_id AND e.d = date""")
def q_inner(spark, sf_dir):
    events = fr.table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("record_id"), F.col("ts").cast("date").alias("date")
    )
    return events.join(fr.panel(spark, sf_dir), ["record_id", "date"], "inner").select(
        "event_id", "record_id", "date", "study_day"
    )


@query("left_join_all", """SELECT c_custkey, n.n_name, r.r_name FROM customer c
LEFT JOIN nation n ON CASE WHEN c_acctbal >= 0 THEN c.c_nationkey END = n.n_nationkey
LEFT JOIN (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) r
  ON CASE WHEN c_acctbal >= 0 THEN c.c_nationkey END = r.n_nationkey""")
def q_left_join_all(spark, sf_dir):
    customer = fr.table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")).alias("nation"))
    nation = fr.table(spark, sf_dir, "nation")
    region = fr.table(spark, sf_dir, "region")
    names = nation.select(F.col("n_nationkey").alias("nation"), "n_name")
    regions = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_nationkey").alias("nation"), "r_name")
    return left_join_all([customer, names, regions], ["nation"]).drop("nation")


@query("left_join_fan_out", f"""WITH {fr.PANEL_SQL},
big AS (SELECT user_id, CAST(ts AS DATE) AS d, event_type FROM events GROUP BY ALL)
SELECT record_id, CAST(date AS VARCHAR) AS date, study_day, event_type FROM panel LEFT JOIN big ON user_id = record_id AND d = date""")
def q_fan_out(spark, sf_dir):
    big = fr.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("record_id"), F.col("ts").cast("date").alias("date"), "event_type"
    ).distinct()
    return fr.panel(spark, sf_dir).drop("days_in_study").join(big, ["record_id", "date"], "left")


NULL_SAFE_SQL = """WITH a AS (SELECT CAST(CASE WHEN c_nationkey % 4 <> 0 THEN c_nationkey END AS BIGINT) AS nation, count(*) AS n_customers FROM customer GROUP BY 1),
b AS (SELECT CAST(CASE WHEN s_nationkey % 3 <> 0 THEN s_nationkey END AS BIGINT) AS nation, count(*) AS n_suppliers FROM supplier GROUP BY 1)
SELECT coalesce(a.nation, b.nation) AS nation, n_customers, n_suppliers FROM a FULL JOIN b ON a.nation IS NOT DISTINCT FROM b.nation"""


def nullable_counts(spark, sf_dir):
    def counts(name, key, step, out):
        nation = F.when(F.col(key) % step != 0, F.col(key)).cast("bigint").alias("nation")
        return fr.table(spark, sf_dir, name).groupBy(nation).agg(F.count(F.lit(1)).alias(out))

    return counts("customer", "c_nationkey", 4, "n_customers"), counts("supplier", "s_nationkey", 3, "n_suppliers")


@query("null_safe_join", NULL_SAFE_SQL)
def q_null_safe(spark, sf_dir):
    return null_safe_join(*nullable_counts(spark, sf_dir), ["nation"])


@query("null_safe_join_from_parts", NULL_SAFE_SQL)
def q_null_safe_parts(spark, sf_dir):
    return null_safe_join(*nullable_counts(spark, sf_dir), ["nation"])


@query("exists_flag", """SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)
  THEN 'Yes' ELSE 'No' END AS had_large_order FROM customer""")
def q_exists(spark, sf_dir):
    large = fr.table(spark, sf_dir, "orders").filter("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return exists_flag(fr.table(spark, sf_dir, "customer").select("c_custkey"), large, ["c_custkey"], "had_large_order")


# Reshape


@query("slots_to_long", f"""WITH {SLOTS_SQL}
SELECT record_id, part, slot, CAST(admit_date AS VARCHAR) AS admit_date, reason FROM urgent""")
def q_slots(spark, sf_dir):
    return slots_to_long(wide_slots(spark, sf_dir), ["record_id", "part"], "hosp(..)_(.*)")


@query("melt_ratings", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, 'Discount' AS symptom, l_discount AS highest_rating FROM lineitem
UNION ALL SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, 'Sales tax', l_tax FROM lineitem""")
def q_melt(spark, sf_dir):
    lines = fr.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_discount").alias("discount_highest_rating"),
        F.col("l_tax").alias("sales_tax_highest_rating"),
    )
    return melt_ratings(lines, ["l_orderkey", "l_linenumber"], cols_like(lines, ends="_highest_rating"))


@query("pivot_counts", """SELECT o_orderpriority, max(n) FILTER (WHERE o_orderstatus = 'F') AS "F",
  max(n) FILTER (WHERE o_orderstatus = 'O') AS "O", max(n) FILTER (WHERE o_orderstatus = 'P') AS "P"
FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1""")
def q_pivot(spark, sf_dir):
    counted = freq(fr.table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"])
    return pivot_counts(counted, ["o_orderpriority"], "o_orderstatus", "n", ["F", "O", "P"])


@query("append_rows", """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier""")
def q_append(spark, sf_dir):
    customer = fr.table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS segment")
    supplier = fr.table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_name AS name")
    return append_rows([customer, supplier])


@query("bind_constants", "SELECT s_suppkey, 'exchangeable' AS corr_structure, CAST(0.95 AS DOUBLE) AS conf_level FROM supplier")
def q_bind(spark, sf_dir):
    return bind_constants(
        fr.table(spark, sf_dir, "supplier").select("s_suppkey"), {"corr_structure": "exchangeable", "conf_level": 0.95}
    )


@query("header_rows", """WITH counted AS (SELECT o_orderpriority AS predictor, o_orderstatus AS level,
  CAST(ascii(o_orderstatus) AS BIGINT) AS level_number, count(*) AS n FROM orders GROUP BY ALL)
SELECT predictor, level, level_number, n FROM counted
UNION ALL SELECT DISTINCT predictor, predictor, 0, NULL FROM counted""")
def q_headers(spark, sf_dir):
    counted = freq(fr.table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"]).select(
        F.col("o_orderpriority").alias("predictor"), F.col("o_orderstatus").alias("level"),
        F.ascii("o_orderstatus").cast("bigint").alias("level_number"), "n",
    )
    return with_header_rows(counted, ["predictor"], F.col("predictor"))


# Aggregates


@query("collapse_events", """SELECT o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day,
  string_agg(coalesce(nullif(o_orderpriority, '5-LOW'), 'NA'), '/' ORDER BY o_orderkey) AS reason,
  min(o_totalprice) AS smallest, max(o_orderstatus) AS status FROM orders GROUP BY 1, 2""")
def q_collapse(spark, sf_dir):
    orders = fr.table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("day"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("reason"),
        F.col("o_totalprice").alias("smallest"), F.col("o_orderstatus").alias("status"),
    )
    return collapse_events(orders, ["o_custkey", "day"], "reason", ["o_orderkey"], ["smallest"], ["status"])


@query("freq", "SELECT o_custkey, count(*) AS number_of_encounters FROM orders GROUP BY o_custkey")
def q_freq(spark, sf_dir):
    return freq(fr.table(spark, sf_dir, "orders"), ["o_custkey"], "number_of_encounters")


@query("freq_with_share", """WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2),
t AS (SELECT *, CAST(sum(n) OVER (PARTITION BY o_orderpriority) AS BIGINT) AS total_n,
  CAST(sum(CASE WHEN o_orderstatus IN ('F', 'P') THEN n ELSE 0 END) OVER (PARTITION BY o_orderpriority) AS BIGINT) AS subset_n FROM c)
SELECT *, round(CAST(n AS DOUBLE) / total_n * 100, 2) AS percent, round(CAST(subset_n AS DOUBLE) / total_n * 100, 2) AS subset_percent FROM t""")
def q_share(spark, sf_dir):
    return freq_with_share(fr.table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "P"])


@query("collapse_rare", """SELECT p_partkey, CASE WHEN n < 205 THEN 'Other' ELSE p_brand END AS p_brand FROM
(SELECT p_partkey, brand AS p_brand, count(*) OVER (PARTITION BY brand) AS n FROM
  (SELECT p_partkey, nullif(p_brand, 'Brand#1') AS brand FROM part))""")
def q_rare(spark, sf_dir):
    part = fr.table(spark, sf_dir, "part").select("p_partkey", F.nullif("p_brand", F.lit("Brand#1")).alias("p_brand"))
    return collapse_rare(part, "p_brand", 205)


SUMMARY_CONTINUOUS = """SELECT '{v}' AS variable, {s} AS stratum, count({v}) AS n, count(*) - count({v}) AS n_missing,
  round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS sd, CAST(min({v}) AS DOUBLE) AS min, CAST(max({v}) AS DOUBLE) AS max FROM {t} {g}"""


def continuous_sql(variables, source, by=None, overall=True):
    parts = []
    for v in variables:
        if overall:
            parts.append(SUMMARY_CONTINUOUS.format(v=v, s="'Overall'", t=source, g=""))
        if by:
            parts.append(SUMMARY_CONTINUOUS.format(v=v, s=by, t=source, g=f"GROUP BY {by}"))
    return " UNION ALL ".join(parts)


@query("summarize_continuous", continuous_sql(["l_quantity", "l_extendedprice", "l_discount"], "lineitem"))
def q_continuous(spark, sf_dir):
    return summarize_continuous(fr.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query("summarize_continuous_by_group", continuous_sql(["l_quantity", "l_extendedprice"], "lineitem", "l_returnflag"))
def q_continuous_by(spark, sf_dir):
    return summarize_continuous(
        fr.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], "l_returnflag", add_overall=True
    )


STATUS_LEVELS = ["F", "O", "P", "X"]
PRIORITY_LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]


def categorical_sql(by: str | None):
    """Counts over all levels in every stratum; values outside the levels are unknown."""
    values = ", ".join(
        [f"('o_orderstatus', '{v}', {i})" for i, v in enumerate(STATUS_LEVELS, 1)]
        + [f"('o_orderpriority', '{v}', {i})" for i, v in enumerate(PRIORITY_LEVELS, 1)]
    )
    strata = "SELECT 'Overall' AS stratum, * FROM orders"
    if by:
        strata += f" UNION ALL SELECT {by} AS stratum, * FROM orders"
    return f"""levels(variable, level, level_number) AS (VALUES {values}),
strata AS ({strata}),
long AS (SELECT stratum, 'o_orderstatus' AS variable, o_orderstatus AS level FROM strata
  UNION ALL SELECT stratum, 'o_orderpriority', o_orderpriority FROM strata),
cells AS (SELECT s.stratum, l.* FROM (SELECT DISTINCT stratum FROM strata) s, levels l),
known AS (SELECT c.variable, c.level, CAST(c.level_number AS BIGINT) AS level_number, c.stratum, count(x.level) AS n FROM cells c
  LEFT JOIN long x ON x.stratum = c.stratum AND x.variable = c.variable AND x.level = c.level GROUP BY ALL),
categorical AS (
SELECT variable, level, level_number, stratum, n,
  round(CAST(n AS DOUBLE) / nullif(sum(n) OVER (PARTITION BY variable, stratum), 0) * 100, 6) AS percent FROM known
UNION ALL
SELECT x.variable, 'Unknown', CASE x.variable WHEN 'o_orderstatus' THEN 5 ELSE 5 END, x.stratum, count(*), NULL FROM long x
WHERE NOT EXISTS (SELECT 1 FROM levels l WHERE l.variable = x.variable AND l.level = x.level) GROUP BY ALL)"""


@query("summarize_categorical", f"WITH {categorical_sql(None)} SELECT * FROM categorical")
def q_categorical(spark, sf_dir):
    return summarize_categorical(
        fr.table(spark, sf_dir, "orders"), {"o_orderstatus": STATUS_LEVELS, "o_orderpriority": PRIORITY_LEVELS}
    )


LARGE = "CASE WHEN o_totalprice > 250000 THEN 'Yes' ELSE 'No' END"


@query("summarize_columns_with_overall", f"""WITH {categorical_sql(LARGE)},
sized AS (SELECT *, {LARGE} AS large FROM orders),
continuous AS ({continuous_sql(["o_totalprice"], "sized", "large")})
SELECT variable, stratum, n, n_missing, mean, sd, min, max, NULL AS level, CAST(NULL AS BIGINT) AS level_number, CAST(NULL AS DOUBLE) AS percent FROM continuous
UNION ALL SELECT variable, stratum, n, NULL, NULL, NULL, NULL, NULL, level, level_number, percent FROM categorical""")
def q_summarize_columns(spark, sf_dir):
    orders = fr.table(spark, sf_dir, "orders").withColumn("large", F.when(F.col("o_totalprice") > 250000, "Yes").otherwise("No"))
    return summarize_columns(
        orders, ["o_totalprice"], {"o_orderstatus": STATUS_LEVELS, "o_orderpriority": PRIORITY_LEVELS}, "large", True
    )


@query("sample_characteristics", """WITH sample AS (
  SELECT c_custkey, c_acctbal, coalesce(nullif(replace(c_mktsegment, 'HOUSEHOLD', 'HOME'), 'MACHINERY'), 'Unknown') AS segment,
    CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000) THEN 'Yes' ELSE 'No' END AS had_event,
    CASE WHEN count(*) OVER (PARTITION BY c_nationkey) < 61 THEN 'Other' ELSE CAST(c_nationkey AS VARCHAR) END AS nation
  FROM customer),
strata AS (SELECT 'Overall' AS stratum, * FROM sample UNION ALL SELECT had_event, * FROM sample),
nation_levels AS (SELECT level, row_number() OVER (ORDER BY level = 'Other', level) AS level_number
  FROM (SELECT DISTINCT nation AS level FROM sample WHERE nation <> 'Other' UNION ALL SELECT 'Other')),
levels(variable, level, level_number) AS (
  SELECT * FROM (VALUES ('segment', 'AUTOMOBILE', 1), ('segment', 'BUILDING', 2), ('segment', 'FURNITURE', 3), ('segment', 'HOME', 4), ('segment', 'Unknown', 5))
  UNION ALL SELECT 'nation', level, level_number FROM nation_levels),
long AS (SELECT stratum, 'segment' AS variable, segment AS level FROM strata UNION ALL SELECT stratum, 'nation', nation FROM strata),
cells AS (SELECT s.stratum, l.* FROM (SELECT DISTINCT stratum FROM strata) s, levels l),
known AS (SELECT c.variable, c.level, CAST(c.level_number AS BIGINT) AS level_number, c.stratum, count(x.level) AS n FROM cells c
  LEFT JOIN long x ON x.stratum = c.stratum AND x.variable = c.variable AND x.level = c.level GROUP BY ALL)
SELECT 'c_acctbal' AS variable, stratum, count(c_acctbal) AS n, CAST(0 AS BIGINT) AS n_missing, round(avg(c_acctbal), 6) AS mean,
  round(stddev_samp(c_acctbal), 6) AS sd, min(c_acctbal) AS min, max(c_acctbal) AS max,
  NULL AS level, CAST(NULL AS BIGINT) AS level_number, CAST(NULL AS DOUBLE) AS percent FROM strata GROUP BY stratum
UNION ALL
SELECT variable, stratum, n, NULL, NULL, NULL, NULL, NULL, level, level_number,
  round(CAST(n AS DOUBLE) / nullif(sum(n) OVER (PARTITION BY variable, stratum), 0) * 100, 6) FROM known""")
def q_sample(spark, sf_dir):
    customer = fr.table(spark, sf_dir, "customer").select(
        "c_custkey", "c_acctbal", F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("segment"),
        F.col("c_nationkey").cast("string").alias("nation"),
    )
    large = fr.table(spark, sf_dir, "orders").filter("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return sample_characteristics(
        customer, ["c_acctbal"], {"segment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOME", "Unknown"]},
        recodes={"segment": {"HOUSEHOLD": "HOME"}}, unknown=["segment"], rare="nation", rare_below=61,
        members=large, id_col="c_custkey",
    )


@query("cluster_counts", "SELECT count(DISTINCT user_id) AS n, count(*) AS n_obs FROM events")
def q_clusters(spark, sf_dir):
    return cluster_counts(fr.table(spark, sf_dir, "events"), "user_id")


@query("level_counts", """WITH levels(level, level_number) AS (VALUES ('F', 1), ('O', 2), ('P', 3), ('X', 4))
SELECT level, CAST(level_number AS BIGINT) AS level_number, count(o_orderkey) AS n_per_level FROM levels
LEFT JOIN orders ON o_orderstatus = level GROUP BY ALL""")
def q_levels(spark, sf_dir):
    return level_counts(fr.table(spark, sf_dir, "orders"), "o_orderstatus", STATUS_LEVELS)


# Tail of chi-square for an even number of degrees of freedom, and the error function as a series of positive terms.
CHI_TAIL = "exp(-{x} / 2) * (SELECT sum(pow({x} / 2, k) / gamma(k + 1)) FROM range(0, CAST({df} / 2 AS BIGINT)) t(k))"
NORMAL_TAIL = "1 - exp(-{z} * {z} / 2) * (SELECT sum(pow(abs({z}) / sqrt(2), 2 * k + 1) / gamma(k + 1.5)) FROM range(0, 120) t(k))"


def chi_sql(source: str, by: str, variable: str) -> str:
    return f"""SELECT '{variable}' AS variable, sum(pow(coalesce(o, 0) - r * c / t, 2) / (r * c / t)) AS statistic,
  (count(DISTINCT lv) - 1) * (count(DISTINCT g) - 1) AS df, CAST(max(t) AS BIGINT) AS n FROM (
  SELECT a.lv, b.g, x.o, CAST(a.r AS DOUBLE) AS r, CAST(b.c AS DOUBLE) AS c, (SELECT count(*) FROM {source}) AS t
  FROM (SELECT {variable} AS lv, count(*) AS r FROM {source} GROUP BY 1) a CROSS JOIN (SELECT {by} AS g, count(*) AS c FROM {source} GROUP BY 1) b
  LEFT JOIN (SELECT {variable} AS lv, {by} AS g, count(*) AS o FROM {source} GROUP BY 1, 2) x ON x.lv = a.lv AND x.g = b.g)"""


def rank_sql(source: str, by: str, variable: str) -> str:
    return f"""SELECT '{variable}' AS variable, w AS statistic,
  (w - na * nb / 2 - sign(w - na * nb / 2) * 0.5) / sqrt(na * nb / 12 * ((na + nb + 1) - ties / ((na + nb) * (na + nb - 1)))) AS z,
  CAST(na + nb AS BIGINT) AS n FROM (
  SELECT sum(ta * (below + (t + 1) / 2)) - sum(ta) * (sum(ta) + 1) / 2 AS w, sum(ta) AS na, sum(t) - sum(ta) AS nb, sum(t * t * t - t) AS ties FROM (
    SELECT CAST(t AS DOUBLE) AS t, CAST(ta AS DOUBLE) AS ta, CAST(sum(t) OVER (ORDER BY v) - t AS DOUBLE) AS below FROM (
      SELECT {variable} AS v, count(*) AS t, count(*) FILTER (WHERE {by} = (SELECT min({by}) FROM {source})) AS ta FROM {source} GROUP BY 1)))"""


COMPARE_SQL = f"""WITH sized AS (SELECT *, {LARGE} AS large FROM orders),
lines AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'Yes' ELSE 'No' END AS returned FROM lineitem),
chi AS ({chi_sql("sized", "large", "o_orderstatus")} UNION ALL {chi_sql("sized", "large", "o_orderpriority")})
SELECT variable, 'chi-square' AS test, round(statistic, 6) AS statistic, df, n,
  round({CHI_TAIL.format(x="statistic", df="df")}, 6) AS p_value FROM chi"""


@query("chi_square_by_group", COMPARE_SQL)
def q_chi(spark, sf_dir):
    orders = fr.table(spark, sf_dir, "orders").withColumn("large", F.when(F.col("o_totalprice") > 250000, "Yes").otherwise("No"))
    return compare_groups(orders, "large", categorical=["o_orderstatus", "o_orderpriority"])


RANK_SQL = f"""WITH lines AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'Yes' ELSE 'No' END AS returned FROM lineitem),
ranks AS ({rank_sql("lines", "returned", "l_quantity")} UNION ALL {rank_sql("lines", "returned", "l_extendedprice")})
SELECT variable, 'rank-sum' AS test, round(statistic, 6) AS statistic, CAST(NULL AS BIGINT) AS df, n,
  round({NORMAL_TAIL.format(z="z")}, 6) AS p_value FROM ranks"""


def returned_lines(spark, sf_dir):
    return fr.table(spark, sf_dir, "lineitem").withColumn(
        "returned", F.when(F.col("l_returnflag") == "R", "Yes").otherwise("No")
    )


@query("rank_sum_by_group", RANK_SQL)
def q_rank(spark, sf_dir):
    return compare_groups(returned_lines(spark, sf_dir), "returned", continuous=["l_quantity", "l_extendedprice"])


@query("rank_sum_in_blocks", RANK_SQL)
def q_rank_blocks(spark, sf_dir):
    return compare_groups(
        returned_lines(spark, sf_dir), "returned", continuous=["l_quantity", "l_extendedprice"]
    )


@query("compare_sample", f"""WITH sample AS (SELECT c_mktsegment, c_acctbal,
    CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000) THEN 'Yes' ELSE 'No' END AS had_event FROM customer),
chi AS ({chi_sql("sample", "had_event", "c_mktsegment")}), ranks AS ({rank_sql("sample", "had_event", "c_acctbal")})
SELECT variable, 'chi-square' AS test, round(statistic, 6) AS statistic, df, n, round({CHI_TAIL.format(x="statistic", df="df")}, 6) AS p_value FROM chi
UNION ALL SELECT variable, 'rank-sum', round(statistic, 6), NULL, n, round({NORMAL_TAIL.format(z="z")}, 6) FROM ranks""")
def q_compare_sample(spark, sf_dir):
    large = fr.table(spark, sf_dir, "orders").filter("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return compare_sample(fr.table(spark, sf_dir, "customer"), large, "c_custkey", ["c_acctbal"], ["c_mktsegment"])


@query("permutation_test")
def q_permutation(spark, sf_dir):
    return permutation_test(fr.table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")


# Ordered operators


@query("number_events", """SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS visit_number FROM orders""")
def q_number(spark, sf_dir):
    orders = fr.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    order = ["o_orderdate", "o_orderkey"]
    return number_rows(orders, "o_custkey", order, "visit_number", bounded_groups=True).drop("o_orderdate")


@query("number_events_in_blocks", """SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS visit_number FROM orders""")
def q_number_blocks(spark, sf_dir):
    """Three keys hold all rows: numbered through range-sorted blocks."""
    orders = fr.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    order = ["o_orderdate", "o_orderkey"]
    return number_rows(orders, "o_orderstatus", order, "visit_number").drop("o_orderdate")


@query("dedupe_first_best", """SELECT o_custkey, CAST(day AS VARCHAR) AS day, o_orderkey FROM (
  SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, o_orderkey, row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE)
    ORDER BY o_totalprice, (CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE 1 END) DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def q_dedupe(spark, sf_dir):
    orders = fr.table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("day"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("answer"),
    )
    return dedupe_first_best(orders, ["o_custkey", "day"], "o_totalprice", ["answer"], ["o_orderkey"]).select(
        "o_custkey", "day", "o_orderkey"
    )


NEIGHBOUR_SQL = """SELECT o_orderkey, lag(o_orderpriority) OVER w AS previous_type, lead(o_orderpriority) OVER w AS next_type,
  CAST(CAST(o_orderdate AS DATE) - lag(CAST(o_orderdate AS DATE)) OVER w AS BIGINT) AS days_since_previous FROM orders
WINDOW w AS (PARTITION BY {key} ORDER BY o_orderdate, o_orderkey)"""


def order_neighbours(spark, sf_dir, key, bounded):
    orders = fr.table(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    orders = orders.select("o_orderkey", key, "day", "o_orderpriority")
    seen = neighbours(
        orders, key, ["day", "o_orderkey"],
        before={"previous_type": "o_orderpriority", "previous_day": "day"}, after={"next_type": "o_orderpriority"},
        bounded_groups=bounded,
    )
    return seen.select(
        "o_orderkey", "previous_type", "next_type", F.datediff("day", "previous_day").alias("days_since_previous")
    )


@query("neighbours", NEIGHBOUR_SQL.format(key="o_custkey"))
def q_neighbours(spark, sf_dir):
    return order_neighbours(spark, sf_dir, "o_custkey", True)


@query("neighbours_in_blocks", NEIGHBOUR_SQL.format(key="o_orderstatus"))
def q_neighbours_blocks(spark, sf_dir):
    return order_neighbours(spark, sf_dir, "o_orderstatus", False)


RUN_SQL = """WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS date FROM events),
m AS (SELECT *, CASE WHEN lead(date) OVER w IS NULL OR lead(date) OVER w - date <> 1 THEN date END AS mark FROM d WINDOW w AS (PARTITION BY user_id ORDER BY date))
SELECT user_id, CAST(date AS VARCHAR) AS date, CAST(first_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY date
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS VARCHAR) AS run_end FROM m"""


def user_days(spark, sf_dir):
    return fr.table(spark, sf_dir, "events").select(
        "user_id", F.col("ts").cast("date").alias("date")
    ).distinct()


@query("run_end", RUN_SQL)
def q_run_end(spark, sf_dir):
    """One row per user and day: a calendar bounds the days of a user."""
    return run_end(user_days(spark, sf_dir), "user_id", "date", bounded_groups=True)


@query("run_end_in_blocks", RUN_SQL)
def q_run_end_blocks(spark, sf_dir):
    return run_end(user_days(spark, sf_dir), "user_id", "date")


FILL_SQL = """SELECT event_id, {f}(CASE WHEN event_id % 5 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY ts, event_id ROWS BETWEEN {a}) AS value FROM events"""


def sparse_values(spark, sf_dir, key):
    return fr.table(spark, sf_dir, "events").select(
        "event_id", "ts", key, F.when(F.col("event_id") % 5 == 0, F.col("value")).alias("value")
    )


BY_TIME = ["ts", "event_id"]


@query("fill_up", FILL_SQL.format(f="first_value", key="user_id", a="CURRENT ROW AND UNBOUNDED FOLLOWING"))
def q_fill_up(spark, sf_dir):
    return fill_up(sparse_values(spark, sf_dir, "user_id"), ["user_id"], BY_TIME, ["value"], bounded_groups=True).select("event_id", "value")


@query("fill_down", FILL_SQL.format(f="last_value", key="user_id", a="UNBOUNDED PRECEDING AND CURRENT ROW"))
def q_fill_down(spark, sf_dir):
    return fill_down(sparse_values(spark, sf_dir, "user_id"), ["user_id"], BY_TIME, ["value"], bounded_groups=True).select("event_id", "value")


@query("fill_down_in_blocks", FILL_SQL.format(f="last_value", key="event_type", a="UNBOUNDED PRECEDING AND CURRENT ROW"))
def q_fill_down_blocks(spark, sf_dir):
    rows = sparse_values(spark, sf_dir, "event_type")
    return fill_down(rows, ["event_type"], BY_TIME, ["value"]).select("event_id", "value")


WITHIN_SQL = """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(CASE WHEN event_type = 'error' AND value > 100 THEN 1 ELSE 0 END) AS n FROM events GROUP BY 1, 2),
w AS (SELECT user_id, day, sum(n) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN {frame}) AS ahead FROM d)
SELECT event_id, CAST(CASE WHEN coalesce(ahead, 0) >= 1 THEN 1 ELSE 0 END AS BIGINT) AS event_within
FROM events e JOIN w ON w.user_id = e.user_id AND w.day = CAST(e.ts AS DATE)"""


def flagged_events(spark, sf_dir):
    return fr.table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("ts").cast("date").alias("day"),
        ((F.col("event_type") == "error") & (F.col("value") > 100)).cast("int").alias("flag"),
    )


@query("event_within_7_days", WITHIN_SQL.format(frame="CURRENT ROW AND INTERVAL 6 DAY FOLLOWING"))
def q_within(spark, sf_dir):
    return event_within(flagged_events(spark, sf_dir), "user_id", "day", "flag").select("event_id", "event_within")


@query("event_within_7_days_after_today", WITHIN_SQL.format(frame="INTERVAL 1 DAY FOLLOWING AND INTERVAL 7 DAY FOLLOWING"))
def q_within_after(spark, sf_dir):
    return event_within(flagged_events(spark, sf_dir), "user_id", "day", "flag", include_today=False).select(
        "event_id", "event_within"
    )


@query("label_with_unknowns", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 11 < 7 THEN NULL ELSE o_orderkey % 2 END AS label
FROM orders""")
def q_unknowns(spark, sf_dir):
    rows = fr.table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderkey % 2 AS flag", "o_orderkey % 11 AS days_left")
    return label_with_unknowns(rows, "flag", "days_left", 7, "label").select("o_orderkey", "label")


@query("next_value", "SELECT event_id, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_value FROM events")
def q_next(spark, sf_dir):
    events = fr.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return next_value(events, "user_id", BY_TIME, "value", "next_value", bounded_groups=True).select("event_id", "next_value")


BH_SQL = """WITH p AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice / 600000 END AS p FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY {f} ORDER BY p NULLS LAST, o_orderkey) AS rn, count(p) OVER (PARTITION BY {f}) AS m FROM p)
SELECT o_orderkey, CASE WHEN p IS NOT NULL THEN round(least(1, min(p * m / rn) OVER (PARTITION BY {f} ORDER BY p NULLS LAST, o_orderkey
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) END AS q_value FROM r"""


def order_p_values(spark, sf_dir):
    return fr.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice") / 600000).alias("p")
    )


@query("fdr_adjusted", BH_SQL.format(f="o_orderpriority"))
def q_fdr(spark, sf_dir):
    return fdr_bh(order_p_values(spark, sf_dir), "p", ["o_orderpriority"], ["o_orderkey"], bounded_groups=True).select("o_orderkey", "q_value")


@query("fdr_adjusted_in_blocks", BH_SQL.format(f="1"))
def q_fdr_blocks(spark, sf_dir):
    """All rows are one family: ranked through range-sorted blocks."""
    return fdr_bh(order_p_values(spark, sf_dir), "p", [], ["o_orderkey"]).select("o_orderkey", "q_value")


@query("sorted_rows", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY r_name, n_name")
def q_sorted(spark, sf_dir):
    nation, region = fr.table(spark, sf_dir, "nation"), fr.table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_name", "r_name").orderBy(
        F.col("r_name").asc_nulls_last(), F.col("n_name").asc_nulls_last()
    )


@query("months_between_tables", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS BIGINT) AS days_since,
  CAST(12 * (year(l_shipdate) - year(o_orderdate)) + (month(l_shipdate) - month(o_orderdate))
    - CASE WHEN day(l_shipdate) < day(o_orderdate) THEN 1 ELSE 0 END AS BIGINT) AS months_since
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def q_months(spark, sf_dir):
    lines = fr.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("ship"))
    orders = fr.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("ordered"))
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return time_since(joined, "ordered", "ship", "days_since", "months_since").select(
        "l_orderkey", "l_linenumber", "days_since", "months_since"
    )

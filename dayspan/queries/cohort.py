"""Panel, event log, responses, labels and everything built on them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dayspan.operators.windows import study_day
from dayspan.plans.analysis import INCL_TODAY, analysis_frame, count_significant, merge_categories
from dayspan.plans.cohort import (
    encounters_per_id,
    event_characteristics,
    ids_with_events,
    participant_timeline,
    rating_frequency,
)
from dayspan.plans.event_log import (
    ED,
    ED_ONLY,
    HOSPITAL,
    HOSPITAL_ONLY,
    MULTIPLE_ED,
    NEXT_DAY,
    SAME_DAY,
    SlotSpec,
    build_event_log,
    categorize_visits,
)
from dayspan.plans.labels import category_flags
from dayspan.plans.panel import expand_panel, panel_from_tables
from dayspan.plans.responses import assign_responses_to_day, highest_ratings, symptom_days
from dayspan.operators.select import null_if
from dayspan.queries import frames as fr
from dayspan.queries.registry import query

WEEKLY_SHARE_SQL = f"""WITH {fr.LABELLED_SQL}
SELECT CAST(study_day // 7 AS BIGINT) AS study_week, count(*) AS n_days, CAST(sum(incl) AS BIGINT) AS n_positive,
  count(incl_unknown) AS n_known, round(CAST(sum(incl) AS DOUBLE) / count(*), 6) AS positive_share
FROM labelled GROUP BY study_day // 7"""


@query("weekly_event_share", WEEKLY_SHARE_SQL)
def weekly_event_share(spark, sf_dir):
    label = "unplanned_healthcare_event_within_7days_incl_today"
    return (
        fr.labelled(spark, sf_dir)
        .groupBy(F.floor(F.col("study_day") / 7).cast("bigint").alias("study_week"))
        .agg(
            F.count(F.lit(1)).alias("n_days"),
            F.sum(label).cast("bigint").alias("n_positive"),
            F.count(INCL_TODAY).alias("n_known"),
            (F.sum(label) / F.count(F.lit(1))).alias("positive_share"),
        )
    )


@query("expand_panel", f"""WITH {fr.PANEL_SQL}
SELECT record_id, CAST(date AS VARCHAR) AS date, study_day, days_in_study FROM panel""")
def q_expand_panel(spark, sf_dir):
    return fr.panel(spark, sf_dir)


@query("expand_panel_without_pause", f"""WITH {fr.SPANS_SQL}
SELECT record_id, CAST(date AS VARCHAR) AS date, dense_rank() OVER (PARTITION BY record_id ORDER BY date) - 1 AS study_day,
  count(*) OVER (PARTITION BY record_id) AS days_in_study
FROM (SELECT record_id, CAST(unnest(generate_series(CAST(s AS TIMESTAMP), CAST(e AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM spans)""")
def q_expand_plain(spark, sf_dir):
    return expand_panel(fr.spans(spark, sf_dir), "record_id", "start_date", "end_date", unique_ids=True)


@query("panel_from_tables", f"""WITH {fr.PANEL_SQL}
SELECT record_id, CAST(date AS VARCHAR) AS date, study_day, days_in_study FROM panel""")
def q_panel_from_tables(spark, sf_dir):
    both = fr.spans(spark, sf_dir)
    pauses = both.filter(F.col("excluded_start_date").isNotNull()).select(
        "record_id", "excluded_start_date", "excluded_end_date"
    )
    return panel_from_tables(
        both.select("record_id", "start_date", "end_date"), pauses, "record_id", "start_date", "end_date",
        "excluded_start_date", "excluded_end_date", 1,
    )


@query("study_day_rank", """SELECT event_id, user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date,
  dense_rank() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)) - 1 AS study_day FROM events""")
def q_study_day(spark, sf_dir):
    days = fr.table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("date").alias("date"))
    return study_day(days, "user_id").select("event_id", "user_id", "date", "study_day")


@query("study_duration", """SELECT event_id, user_id,
  max(day) OVER (PARTITION BY user_id) + 1 AS days_in_study
FROM (SELECT event_id, user_id, dense_rank() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)) - 1 AS day FROM events)""")
def q_study_duration(spark, sf_dir):
    days = fr.table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("date").alias("date"))
    return study_day(days, "user_id", duration="days_in_study").select("event_id", "user_id", "days_in_study")


def wide_slots(spark, sf_dir):
    """All orders of a customer as numbered columns: urgent ones in ten hospital slots, others in ten emergency slots.

    A customer with more orders of a kind has further rows, told apart by ``part``.
    """
    orders = fr.table(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    number = F.row_number().over(Window.partitionBy("o_custkey", urgent).orderBy("o_orderkey")) - 1
    placed = orders.withColumn("n", number).withColumns({"part": F.expr("n div 10"), "slot": F.col("n") % 10})
    columns = {}
    for i in range(10):
        for kind, is_kind, date, reason in (("hosp", urgent, "admit_date", "o_orderpriority"), ("edvisit", ~urgent, "date", "o_orderstatus")):
            here = is_kind & (F.col("slot") == i)
            columns[f"{kind}{i + 1:02}_{date}"] = F.max(F.when(here, F.col("day")))
            columns[f"{kind}{i + 1:02}_reason"] = F.max(F.when(here, F.col(reason)))
    return placed.groupBy(F.col("o_custkey").alias("record_id"), "part").agg(*[c.alias(n) for n, c in columns.items()])


SLOTS_SQL = """
slotted AS (
  SELECT o_custkey AS record_id, CAST(o_orderdate AS DATE) AS date, o_orderpriority, o_orderstatus, o_orderpriority IN ('1-URGENT', '2-HIGH') AS is_urgent,
    row_number() OVER (PARTITION BY o_custkey, o_orderpriority IN ('1-URGENT', '2-HIGH') ORDER BY o_orderkey) - 1 AS k FROM orders
),
urgent AS (
  SELECT record_id, k // 10 AS part, lpad(CAST(k % 10 + 1 AS VARCHAR), 2, '0') AS slot, date AS admit_date, o_orderpriority AS reason FROM slotted WHERE is_urgent
),
other AS (
  SELECT record_id, k // 10 AS part, lpad(CAST(k % 10 + 1 AS VARCHAR), 2, '0') AS slot, date, o_orderstatus AS reason FROM slotted WHERE NOT is_urgent
)"""

SPECS = [
    SlotSpec("hosp(..)_(.*)", "admit_date", HOSPITAL, "hospitalization_number"),
    SlotSpec("edvisit(..)_(.*)", "date", ED, "ed_visit_number"),
]

EVENT_LOG_SQL = SLOTS_SQL + """,
log AS (
  SELECT record_id, admit_date AS date, 'Hospitalization' AS visit_type, 0 AS rank, part, slot, reason, admit_date FROM urgent
  UNION ALL SELECT record_id, date, 'ED', 1, part, slot, reason, NULL FROM other
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY date NULLS LAST, rank, part, slot) AS visit_number,
    CASE WHEN rank = 0 THEN row_number() OVER (PARTITION BY record_id, rank ORDER BY date NULLS LAST, part, slot) END AS hospitalization_number,
    CASE WHEN rank = 1 THEN row_number() OVER (PARTITION BY record_id, rank ORDER BY date NULLS LAST, part, slot) END AS ed_visit_number
  FROM log
)
SELECT record_id, CAST(date AS VARCHAR) AS date, visit_type, reason, CAST(admit_date AS VARCHAR) AS admit_date,
  visit_number, hospitalization_number, ed_visit_number FROM numbered n"""


@query("event_log", f"WITH {EVENT_LOG_SQL}")
def q_event_log(spark, sf_dir):
    return build_event_log(wide_slots(spark, sf_dir), "record_id", SPECS, tie=["part"], bounded_groups=True)


@query("event_log_in_panel", f"""WITH {EVENT_LOG_SQL}
WHERE EXISTS (SELECT 1 FROM (SELECT o_custkey AS c, min(CAST(o_orderdate AS DATE)) AS s FROM orders GROUP BY 1) b
  WHERE b.c = n.record_id AND n.date BETWEEN b.s AND b.s + 400)""")
def q_event_log_in_panel(spark, sf_dir):
    bounds = fr.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("record_id")).agg(
        F.min(F.col("o_orderdate").cast("date")).alias("s")
    ).withColumn("e", F.date_add("s", 400))
    panel = expand_panel(bounds, "record_id", "s", "e", unique_ids=True)
    return build_event_log(wide_slots(spark, sf_dir), "record_id", SPECS, panel, ["part"], bounded_groups=True, unique_days=True)


@query("categorize_visits", f"""WITH {fr.CATEGORIZED_SQL}
SELECT event_id, record_id, CAST(date AS VARCHAR) AS date, visit_type, visit_category FROM categorized""")
def q_categorize(spark, sf_dir):
    included = fr.encounters(spark, sf_dir).filter(F.col("include_yes_no") == "yes")
    return categorize_visits(included, "record_id", tie=["event_id"], bounded_groups=True).select(
        "event_id", "record_id", "date", "visit_type", "visit_category"
    )


@query("categorize_visits_in_blocks", f"""WITH {fr.CATEGORIZED_SQL}
SELECT event_id, record_id, CAST(date AS VARCHAR) AS date, visit_type, visit_category FROM categorized""")
def q_categorize_blocks(spark, sf_dir):
    """The same through range-sorted blocks, the way taken for ids with very many rows."""
    included = fr.encounters(spark, sf_dir).filter(F.col("include_yes_no") == "yes")
    return categorize_visits(included, "record_id", tie=["event_id"]).select(
        "event_id", "record_id", "date", "visit_type", "visit_category"
    )


MERGED_OUT = """SELECT record_id, CAST(date AS VARCHAR) AS date, visit_category, visit_reason,
  CAST(hospitalization_admit_date AS VARCHAR) AS hospitalization_admit_date,
  CAST(hospitalization_discharge_date AS VARCHAR) AS hospitalization_discharge_date,
  CAST(hospitalization_length_of_stay_days AS BIGINT) AS hospitalization_length_of_stay_days FROM merged"""


@query("merge_adjacent_events", f"WITH {fr.MERGED_SQL} {MERGED_OUT}")
def q_merge(spark, sf_dir):
    return fr.merged_events(spark, sf_dir)


@query("category_flags", f"""WITH {fr.MERGED_SQL}
SELECT record_id, CAST(date AS VARCHAR) AS date, visit_category, CAST(1 AS BIGINT) AS unplanned_healthcare_event,
  CAST(CASE WHEN visit_category = 'ED visit only' THEN 1 ELSE 0 END AS BIGINT) AS ed_only,
  CAST(CASE WHEN visit_category = 'Hospitalization only' THEN 1 ELSE 0 END AS BIGINT) AS hospital_only,
  CAST(CASE WHEN visit_category = 'ED visit and same-day hospitalization' THEN 1 ELSE 0 END AS BIGINT) AS ed_and_hospital
FROM merged""")
def q_flags(spark, sf_dir):
    return category_flags(fr.merged_events(spark, sf_dir)).select(
        "record_id", "date", "visit_category", "unplanned_healthcare_event", "ed_only", "hospital_only", "ed_and_hospital"
    )


@query("label_windows", f"""WITH {fr.LABELLED_SQL}
SELECT record_id, CAST(date AS VARCHAR) AS date, study_day, visit_category, CAST(ev AS BIGINT) AS unplanned_healthcare_event,
  CAST(ed_only AS BIGINT) AS ed_only, CAST(hospital_only AS BIGINT) AS hospital_only,
  CAST(ed_and_hospital AS BIGINT) AS ed_and_hospital,
  CAST(incl AS BIGINT) AS unplanned_healthcare_event_within_7days_incl_today,
  CAST(incl_unknown AS BIGINT) AS unplanned_healthcare_event_within_7days_incl_today_with_unknowns,
  CAST(excl_unknown AS BIGINT) AS unplanned_healthcare_event_within_7days_excl_today_with_unknowns
FROM labelled""")
def q_label_windows(spark, sf_dir):
    return fr.labelled(spark, sf_dir).drop(
        "visit_reason", "hospitalization_admit_date", "hospitalization_discharge_date",
        "hospitalization_length_of_stay_days",
    )


@query("assign_responses_to_day", """SELECT event_id, user_id AS record_id,
  CAST(CASE WHEN strftime(ts, '%H:%M:%S') > '00:00:00' AND strftime(ts, '%H:%M:%S') < '02:00:00'
    THEN CAST(ts AS DATE) - 1 ELSE CAST(ts AS DATE) END AS VARCHAR) AS date,
  round(value, 6) AS progress FROM events""")
def q_assign_day(spark, sf_dir):
    typed = assign_responses_to_day(fr.responses(spark, sf_dir), day_end="02:00:00")
    return typed.select(F.col("response_id").cast("bigint").alias("event_id"), "record_id", "date", "progress")


@query("clean_responses", f"""WITH {fr.RESPONSES_SQL}
SELECT record_id, lpad(CAST(event_id AS VARCHAR), 20, '0') AS response_id, CAST(date AS VARCHAR) AS date,
  strftime(start_ts, '%Y-%m-%d %H:%M:%S') AS start_date, round(progress, 6) AS progress, duration_seconds,
  pain_sev, pain_freq, nausea_sev FROM daily""")
def q_clean(spark, sf_dir):
    return fr.daily_responses(spark, sf_dir)


@query("highest_ratings", f"""WITH {fr.RESPONSES_SQL}
SELECT record_id, CAST(date AS VARCHAR) AS date, greatest(pain_sev, pain_freq) AS pain_highest_rating,
  nausea_sev AS nausea_highest_rating FROM daily""")
def q_highest(spark, sf_dir):
    return highest_ratings(fr.daily_responses(spark, sf_dir))


@query("highest_ratings_by_substring", f"""WITH {fr.RESPONSES_SQL}
SELECT record_id, CAST(date AS VARCHAR) AS date, greatest(pain_sev, pain_freq, nausea_sev) AS pain_highest_rating,
  nausea_sev AS pain_in_the_abdomen_highest_rating FROM daily""")
def q_highest_substring(spark, sf_dir):
    renamed = fr.daily_responses(spark, sf_dir).withColumnRenamed("nausea_sev", "pain_in_the_abdomen_sev")
    return highest_ratings(renamed, match="substring")


@query("symptom_days", f"""WITH {fr.SYMPTOMS_SQL}
SELECT record_id, CAST(date AS VARCHAR) AS date, study_day, pain_highest_rating, nausea_highest_rating,
  CAST(pain_symptom_day AS BIGINT) AS pain_symptom_day, CAST(nausea_symptom_day AS BIGINT) AS nausea_symptom_day
FROM symptoms""")
def q_symptoms(spark, sf_dir):
    return fr.symptoms(spark, sf_dir)


@query("symptom_days_recode_before_join", f"""WITH {fr.SYMPTOMS_SQL}
SELECT record_id, CAST(date AS VARCHAR) AS date, study_day,
  CASE WHEN pain_symptom_day IS NOT NULL THEN pain_highest_rating END AS pain_highest_rating,
  CASE WHEN pain_symptom_day IS NOT NULL THEN nausea_highest_rating END AS nausea_highest_rating,
  CAST(pain_symptom_day AS BIGINT) AS pain_symptom_day, CAST(nausea_symptom_day AS BIGINT) AS nausea_symptom_day
FROM symptoms""")
def q_symptoms_before(spark, sf_dir):
    return symptom_days(fr.daily_responses(spark, sf_dir), fr.panel(spark, sf_dir), recode="before_join")


def model_rows(spark, sf_dir):
    """Result rows made from order totals, one per priority and flag name."""
    orders = fr.table(spark, sf_dir, "orders")
    return orders.groupBy("o_orderpriority").agg(
        (F.sum(F.col("o_orderkey") % 7) / F.sum(F.col("o_orderkey") % 5)).alias("or"),
        (F.min(F.col("o_totalprice")) / F.max("o_totalprice")).alias("wald_p_value"),
    ).withColumn(
        "predictor",
        F.when(F.col("o_orderpriority") == "1-URGENT", "pain_symptom_day")
        .when(F.col("o_orderpriority") == "2-HIGH", "nausea_symptom_day")
        .otherwise(F.col("o_orderpriority")),
    )


@query("count_significant", f"""WITH {fr.SYMPTOMS_SQL},
results AS (
  SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'pain_symptom_day' WHEN '2-HIGH' THEN 'nausea_symptom_day' ELSE o_orderpriority END AS predictor,
    sum(o_orderkey % 7) / sum(o_orderkey % 5) AS odds, min(o_totalprice) / max(o_totalprice) AS p
  FROM orders GROUP BY o_orderpriority
),
chosen AS (SELECT DISTINCT predictor FROM results WHERE regexp_matches(predictor, 'symptom_day$') AND odds >= 1 AND p < 0.1)
SELECT record_id, CAST(date AS VARCHAR) AS date, study_day, pain_highest_rating, nausea_highest_rating,
  CAST(CASE WHEN EXISTS (SELECT 1 FROM chosen WHERE predictor = 'pain_symptom_day') THEN pain_symptom_day ELSE 0 END
    + CASE WHEN EXISTS (SELECT 1 FROM chosen WHERE predictor = 'nausea_symptom_day') THEN nausea_symptom_day ELSE 0 END AS BIGINT)
    AS number_of_significant_individual_symptoms
FROM symptoms""")
def q_count_significant(spark, sf_dir):
    counted, _ = count_significant(fr.symptoms(spark, sf_dir), [model_rows(spark, sf_dir)])
    return counted


@query("significant_names", """WITH results AS (
  SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'pain_symptom_day' WHEN '2-HIGH' THEN 'nausea_symptom_day' ELSE o_orderpriority END AS predictor,
    sum(o_orderkey % 7) / sum(o_orderkey % 5) AS odds, min(o_totalprice) / max(o_totalprice) AS p
  FROM orders GROUP BY o_orderpriority)
SELECT DISTINCT regexp_replace(predictor, '_symptom_day$', '') AS predictor FROM results
WHERE regexp_matches(predictor, 'symptom_day$') AND odds >= 1 AND p < 0.1""")
def q_significant_names(spark, sf_dir):
    return count_significant(fr.symptoms(spark, sf_dir), [model_rows(spark, sf_dir)])[1]


ANALYSIS_SQL = fr.LABELLED_SQL + "," + fr.SYMPTOMS_SQL.replace(fr.PANEL_SQL + ",", "", 1)


@query("analysis_frame", f"""WITH {ANALYSIS_SQL}
SELECT l.record_id, CAST(l.date AS VARCHAR) AS date, l.study_day,
  CAST(l.incl_unknown AS BIGINT) AS {INCL_TODAY},
  CASE s.pain_symptom_day WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' END AS pain_symptom_day,
  CASE s.nausea_symptom_day WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' END AS nausea_symptom_day
FROM labelled l JOIN symptoms s ON l.record_id = s.record_id AND l.date = s.date
WHERE l.incl_unknown IS NOT NULL AND s.pain_symptom_day IS NOT NULL""")
def q_analysis_frame(spark, sf_dir):
    return symptom_analysis(spark, sf_dir)


def symptom_analysis(spark, sf_dir, exclude_today=False):
    flags = fr.symptoms(spark, sf_dir).select(
        "record_id", "date", "study_day", "pain_symptom_day", "nausea_symptom_day"
    )
    return analysis_frame(fr.labelled(spark, sf_dir), flags, exclude_today)[0]


def count_analysis(spark, sf_dir):
    counts = fr.symptoms(spark, sf_dir).select(
        "record_id", "date", "study_day",
        (F.col("pain_symptom_day") + F.col("nausea_symptom_day")).alias("number_of_symptoms"),
    )
    return analysis_frame(fr.labelled(spark, sf_dir), counts, bin_col="number_of_symptoms", cutpoint=2)


@query("analysis_frame_binned", f"""WITH {ANALYSIS_SQL}
SELECT l.record_id, CAST(l.date AS VARCHAR) AS date, l.study_day,
  CAST(l.incl_unknown AS BIGINT) AS {INCL_TODAY},
  CAST(s.pain_symptom_day + s.nausea_symptom_day AS BIGINT) AS number_of_symptoms,
  CASE WHEN s.pain_symptom_day + s.nausea_symptom_day >= 2 THEN '2+'
    ELSE CAST(s.pain_symptom_day + s.nausea_symptom_day AS VARCHAR) END AS number_of_symptoms_binned
FROM labelled l JOIN symptoms s ON l.record_id = s.record_id AND l.date = s.date
WHERE l.incl_unknown IS NOT NULL AND s.pain_symptom_day IS NOT NULL""")
def q_analysis_binned(spark, sf_dir):
    return count_analysis(spark, sf_dir)[0]


@query("analysis_frame_excluding_today", f"""WITH {ANALYSIS_SQL}
SELECT l.record_id, CAST(l.date AS VARCHAR) AS date, l.study_day,
  CAST(l.excl_unknown AS BIGINT) AS unplanned_healthcare_event_within_7days_excl_today_with_unknowns,
  CASE s.pain_symptom_day WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' END AS pain_symptom_day,
  CASE s.nausea_symptom_day WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' END AS nausea_symptom_day
FROM labelled l JOIN symptoms s ON l.record_id = s.record_id AND l.date = s.date
WHERE l.excl_unknown IS NOT NULL AND s.pain_symptom_day IS NOT NULL""")
def q_analysis_excluding(spark, sf_dir):
    return symptom_analysis(spark, sf_dir, exclude_today=True)


@query("merge_categories", """
WITH a AS (SELECT c_custkey AS record_id, CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS cancer_type_from_emr FROM customer),
b AS (SELECT c_custkey + 10 AS record_id, CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS cancer_type_from_emr,
  'type ' || c_nationkey AS category FROM customer)
SELECT coalesce(a.record_id, b.record_id) AS record_id, coalesce(a.cancer_type_from_emr, b.cancer_type_from_emr) AS cancer_type_from_emr,
  b.category AS category_known, '' AS category_new, '' AS notes
FROM a FULL JOIN b ON a.record_id = b.record_id AND a.cancer_type_from_emr IS NOT DISTINCT FROM b.cancer_type_from_emr""")
def q_merge_categories(spark, sf_dir):
    customer = fr.table(spark, sf_dir, "customer")
    segment = F.when(F.col("c_nationkey") % 5 == 0, None).otherwise(F.col("c_mktsegment"))
    diagnoses = customer.select(F.col("c_custkey").alias("record_id"), segment.alias("cancer_type"))
    known = customer.select(
        (F.col("c_custkey") + 10).alias("record_id"), segment.alias("cancer_type_from_emr"),
        F.concat(F.lit("type "), F.col("c_nationkey").cast("string")).alias("category"),
    )
    return merge_categories(
        diagnoses, known, "record_id", "cancer_type", "cancer_type_from_emr", "category", "category_known",
        ["category_new", "notes"],
    )


@query("ids_with_events", f"""WITH {fr.LABELLED_SQL}
SELECT DISTINCT record_id FROM labelled WHERE visit_category IS NOT NULL""")
def q_ids_with_events(spark, sf_dir):
    return ids_with_events(fr.labelled(spark, sf_dir))


@query("encounters_per_id", f"""WITH {fr.LABELLED_SQL}
SELECT record_id, count(*) AS number_of_encounters FROM labelled WHERE visit_category IS NOT NULL GROUP BY record_id""")
def q_encounters(spark, sf_dir):
    return encounters_per_id(fr.labelled(spark, sf_dir))


CATEGORIES = [ED_ONLY, HOSPITAL_ONLY, SAME_DAY, NEXT_DAY, MULTIPLE_ED]


@query("event_characteristics", f"""WITH {fr.LABELLED_SQL},
ev AS (SELECT * FROM labelled WHERE visit_category IS NOT NULL),
long AS (
  SELECT 'study_day' AS variable, CAST(study_day AS DOUBLE) AS v FROM ev
  UNION ALL SELECT 'hospitalization_length_of_stay_days', CAST(hospitalization_length_of_stay_days AS DOUBLE) FROM ev
),
levels(variable, level, level_number) AS (VALUES
  ('visit_category', 'ED visit only', 1), ('visit_category', 'Hospitalization only', 2),
  ('visit_category', 'ED visit and same-day hospitalization', 3), ('visit_category', 'ED visit and next-day hospitalization', 4),
  ('visit_category', 'Multiple same-day ED visits', 5)
  UNION ALL SELECT 'visit_year', CAST(y AS VARCHAR), row_number() OVER (ORDER BY y) FROM (SELECT DISTINCT year(date) AS y FROM ev) AS years
),
cats AS (
  SELECT 'visit_category' AS variable, visit_category AS level, count(*) AS n FROM ev GROUP BY 2
  UNION ALL SELECT 'visit_year', CAST(year(date) AS VARCHAR), count(*) FROM ev GROUP BY 2
)
SELECT variable, 'Overall' AS stratum, count(v) AS n, count(*) - count(v) AS n_missing, round(avg(v), 6) AS mean,
  round(stddev_samp(v), 6) AS sd, min(v) AS min, max(v) AS max, NULL AS level, NULL AS level_number, CAST(NULL AS DOUBLE) AS percent
FROM long GROUP BY variable
UNION ALL
SELECT l.variable, 'Overall', coalesce(c.n, 0), NULL, NULL, NULL, NULL, NULL, l.level, CAST(l.level_number AS BIGINT),
  round(coalesce(c.n, 0) / CAST(sum(coalesce(c.n, 0)) OVER (PARTITION BY l.variable) AS DOUBLE) * 100, 6)
FROM levels l LEFT JOIN cats c ON l.variable = c.variable AND l.level = c.level""")
def q_event_characteristics(spark, sf_dir):
    return event_characteristics(fr.labelled(spark, sf_dir), CATEGORIES)


RATING_CELLS = ", ".join(
    f"CAST(sum(n) FILTER (WHERE rating = '{r}') AS BIGINT) AS \"{r}\"" for r in ("Not endorsed or 0", "1", "2", "3", "4")
)
RATINGS_LONG_SQL = """
shown AS (
  SELECT 'Pain' AS symptom, CASE WHEN pain_highest_rating IN (-1, 0) THEN 'Not endorsed or 0' ELSE CAST(CAST(pain_highest_rating AS INTEGER) AS VARCHAR) END AS rating
  FROM symptoms WHERE pain_symptom_day IS NOT NULL
  UNION ALL
  SELECT 'Nausea', CASE WHEN nausea_highest_rating IN (-1, 0) THEN 'Not endorsed or 0' ELSE CAST(CAST(nausea_highest_rating AS INTEGER) AS VARCHAR) END
  FROM symptoms WHERE pain_symptom_day IS NOT NULL
),
counted AS (SELECT symptom, rating, count(*) AS n FROM shown GROUP BY 1, 2)"""


@query("rating_frequency", f"""WITH {fr.SYMPTOMS_SQL}, {RATINGS_LONG_SQL}
SELECT symptom, {RATING_CELLS},
  CAST(coalesce(sum(n) FILTER (WHERE rating IN ('2', '3', '4')), 0) AS BIGINT) AS "Moderate-to-severe"
FROM counted GROUP BY symptom""")
def q_rating_frequency(spark, sf_dir):
    labels = fr.symptoms(spark, sf_dir)
    ratings = labels.select("record_id", "date", "study_day", "pain_highest_rating", "nausea_highest_rating")
    return rating_frequency(labels, ratings, "pain_symptom_day", as_text=False)


def n_percent_sql(n: str, whole: str) -> str:
    share = f"rtrim(rtrim(format('{{:.2f}}', round(CAST({n} AS DOUBLE) / {whole} * 100, 2)), '0'), '.')"
    return f"format('{{:,}}', CAST({n} AS BIGINT)) || ' (' || {share} || '%)'"


RATING_TEXTS = ", ".join(
    f"max(CASE WHEN rating = '{r}' THEN {n_percent_sql('n', 'total')} END) AS \"{r}\"" for r in ("Not endorsed or 0", "1", "2", "3", "4")
)


@query("rating_frequency_text", f"""WITH {fr.SYMPTOMS_SQL}, {RATINGS_LONG_SQL},
summed AS (SELECT *, sum(n) OVER w AS total, coalesce(sum(n) FILTER (WHERE rating IN ('2', '3', '4')) OVER w, 0) AS severe
  FROM counted WINDOW w AS (PARTITION BY symptom))
SELECT symptom, {RATING_TEXTS}, max({n_percent_sql('severe', 'total')}) AS "Moderate-to-severe" FROM summed GROUP BY symptom""")
def q_rating_frequency_text(spark, sf_dir):
    labels = fr.symptoms(spark, sf_dir)
    ratings = labels.select("record_id", "date", "study_day", "pain_highest_rating", "nausea_highest_rating")
    return rating_frequency(labels, ratings, "pain_symptom_day")


@query("participant_timeline", f"""WITH {ANALYSIS_SQL}
SELECT record_id, CAST(date AS VARCHAR) AS date, study_day, 'UHE' AS series, CAST(ev AS VARCHAR) AS value FROM labelled WHERE record_id = 7
UNION ALL
SELECT record_id, CAST(date AS VARCHAR), study_day, 'Pain',
  CASE WHEN pain_highest_rating IN (-1, 0) THEN 'Not endorsed or 0' ELSE CAST(CAST(pain_highest_rating AS INTEGER) AS VARCHAR) END
FROM symptoms WHERE record_id = 7
UNION ALL
SELECT record_id, CAST(date AS VARCHAR), study_day, 'Nausea',
  CASE WHEN nausea_highest_rating IN (-1, 0) THEN 'Not endorsed or 0' ELSE CAST(CAST(nausea_highest_rating AS INTEGER) AS VARCHAR) END
FROM symptoms WHERE record_id = 7
UNION ALL
SELECT record_id, CAST(date AS VARCHAR), study_day, 'Number of symptoms',
  CASE WHEN pain_symptom_day IS NULL THEN 'Unknown' WHEN pain_symptom_day + nausea_symptom_day >= 5 THEN '5+'
    ELSE CAST(pain_symptom_day + nausea_symptom_day AS VARCHAR) END
FROM symptoms WHERE record_id = 7""")
def q_timeline(spark, sf_dir):
    labels = fr.symptoms(spark, sf_dir)
    ratings = labels.select("record_id", "date", "study_day", "pain_highest_rating", "nausea_highest_rating")
    counts = labels.withColumn("number_of_symptoms", F.col("pain_symptom_day") + F.col("nausea_symptom_day"))
    return participant_timeline(fr.labelled(spark, sf_dir), ratings, counts, 7, "number_of_symptoms")


@query("null_marker_text", f"""WITH {fr.ENCOUNTERS_SQL}
SELECT event_id, visit_reason FROM encounters""")
def q_null_if(spark, sf_dir):
    return null_if(fr.encounters(spark, sf_dir).select("event_id", "visit_reason"), ["visit_reason"])

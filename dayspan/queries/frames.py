"""Cohort frames derived from the given tables, in Spark and as SQL common table expressions.

A user of ``events`` plays the participant, the days from the first to the last
event are the study period (with a pause for every fifth user), and every event is
both a response and an encounter under review: large ``error`` and ``purchase`` events
are mostly included, all others are not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayspan.plans.event_log import merge_adjacent_events
from dayspan.plans.labels import label_windows
from dayspan.plans.panel import expand_panel
from dayspan.plans.responses import assign_responses_to_day, clean_responses, symptom_days


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans(spark, sf_dir) -> DataFrame:
    day = F.col("ts").cast("date")
    bounds = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("record_id")).agg(
        F.min(day).alias("start_date"), F.max(day).alias("end_date")
    )
    paused = F.col("record_id") % 5 == 0
    return bounds.withColumns(
        {
            "excluded_start_date": F.when(paused, F.date_add("start_date", 7)),
            "excluded_end_date": F.when(paused, F.date_add("start_date", 9)),
        }
    )


def panel(spark, sf_dir) -> DataFrame:
    return expand_panel(
        spans(spark, sf_dir), "record_id", "start_date", "end_date", "excluded_start_date", "excluded_end_date", 1,
        unique_ids=True,
    )


def key_number():
    return F.get_json_object("props", "$.k").cast("int")


def encounters(spark, sf_dir) -> DataFrame:
    """All events as reviewed encounters with a free-text decision."""
    k = F.col("k")
    hospital = F.col("event_type") == "purchase"
    minor = ~F.col("event_type").isin("error", "purchase") | (F.col("value") <= 100)
    return (
        table(spark, sf_dir, "events")
        .withColumns({"k": key_number(), "date": F.col("ts").cast("date")})
        .select(
            "event_id", F.col("user_id").alias("record_id"), "date",
            F.when(hospital, "Hospitalization").otherwise("ED").alias("visit_type"),
            F.when(k % 10 == 0, "NA").otherwise(F.concat(F.lit("reason "), k.cast("string"))).alias("visit_reason"),
            F.when(minor, "no, minor").when(k % 7 == 0, "no, planned").when(k % 9 == 0, "unclear").otherwise("yes").alias("include_yes_no"),
            F.when(hospital, F.col("date")).alias("hospitalization_admit_date"),
            F.when(hospital, F.date_add("date", k % 5)).alias("hospitalization_discharge_date"),
            F.when(hospital, k % 5).alias("hospitalization_length_of_stay_days"),
        )
    )


def merged_events(spark, sf_dir, bounded_groups=True) -> DataFrame:
    return merge_adjacent_events(
        encounters(spark, sf_dir), "record_id", ["event_id"], text_cols=["visit_reason"], bounded_groups=bounded_groups
    )


def labelled(spark, sf_dir) -> DataFrame:
    return label_windows(panel(spark, sf_dir), merged_events(spark, sf_dir))


def responses(spark, sf_dir) -> DataFrame:
    """All events as survey responses with text answers, as they come from a survey table."""
    k = F.col("k")
    return table(spark, sf_dir, "events").withColumn("k", key_number()).select(
        F.col("user_id").cast("string").alias("id"),
        F.col("user_id").alias("record_id"),
        F.lpad(F.col("event_id").cast("string"), 20, "0").alias("ResponseId"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("StartDate"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("EndDate"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("RecordedDate"),
        F.col("value").cast("string").alias("Progress"),
        F.col("k").cast("string").alias("Duration (in seconds)"),
        (k % 5).cast("string").alias("d_pain_sev"),
        F.nullif((k % 7).cast("string"), F.lit("6")).alias("d_pain_freq"),
        F.when(k % 3 == 0, "n/a").otherwise((k % 3).cast("string")).alias("d_naus_sev"),
        F.when(k % 4 == 0, None).otherwise((k % 4).cast("string")).alias("d_other_sev"),
    )


RESPONSE_NAMES = {
    "d_pain_sev": "pain_sev", "d_pain_freq": "pain_freq", "d_naus_sev": "nausea_sev", "d_other_sev": "other_sev",
}


def daily_responses(spark, sf_dir) -> DataFrame:
    return clean_responses(assign_responses_to_day(responses(spark, sf_dir)), 20, RESPONSE_NAMES)


def symptoms(spark, sf_dir, recode="after_join") -> DataFrame:
    return symptom_days(daily_responses(spark, sf_dir), panel(spark, sf_dir), recode=recode)


SPANS_SQL = """
bounds AS (
  SELECT user_id AS record_id, min(CAST(ts AS DATE)) AS s, max(CAST(ts AS DATE)) AS e FROM events GROUP BY user_id
),
spans AS (
  SELECT record_id, s, e, CASE WHEN record_id % 5 = 0 THEN s + 7 END AS xs, CASE WHEN record_id % 5 = 0 THEN s + 9 END AS xe
  FROM bounds
)"""

PANEL_SQL = SPANS_SQL + """,
panel_days AS (
  SELECT record_id, CAST(unnest(generate_series(CAST(s AS TIMESTAMP), CAST(coalesce(xs - 1, e) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date
  FROM spans
  UNION ALL
  SELECT record_id, CAST(unnest(generate_series(CAST(xe + 1 AS TIMESTAMP), CAST(e AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE)
  FROM spans WHERE xs IS NOT NULL
),
panel AS (
  SELECT record_id, date, dense_rank() OVER (PARTITION BY record_id ORDER BY date) - 1 AS study_day,
         count(*) OVER (PARTITION BY record_id) AS days_in_study
  FROM panel_days
)"""

ENCOUNTERS_SQL = """
keyed AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k, CAST(ts AS DATE) AS date FROM events),
encounters AS (
  SELECT event_id, user_id AS record_id, date,
    CASE WHEN event_type = 'purchase' THEN 'Hospitalization' ELSE 'ED' END AS visit_type,
    CASE WHEN k % 10 = 0 THEN NULL ELSE 'reason ' || k END AS visit_reason,
    CASE WHEN event_type NOT IN ('error', 'purchase') OR value <= 100 THEN 'no, minor' WHEN k % 7 = 0 THEN 'no, planned' WHEN k % 9 = 0 THEN 'unclear' ELSE 'yes' END AS include_yes_no,
    CASE WHEN event_type = 'purchase' THEN date END AS admit,
    CASE WHEN event_type = 'purchase' THEN date + k % 5 END AS discharge,
    CASE WHEN event_type = 'purchase' THEN k % 5 END AS stay
  FROM keyed
)"""

CATEGORIZED_SQL = ENCOUNTERS_SQL + """,
placed AS (
  SELECT *, lag(visit_type) OVER w AS pt, date - lag(date) OVER w AS pg,
         lead(visit_type) OVER w AS nt, lead(date) OVER w - date AS ng
  FROM encounters WHERE include_yes_no = 'yes'
  WINDOW w AS (PARTITION BY record_id ORDER BY date, visit_type, event_id)
),
categorized AS (
  SELECT *, CASE
    WHEN visit_type = 'Hospitalization' AND pt = 'ED' AND pg = 0 THEN 'ED visit and same-day hospitalization'
    WHEN visit_type = 'ED' AND nt = 'Hospitalization' AND ng = 0 THEN 'ED visit and same-day hospitalization'
    WHEN visit_type = 'Hospitalization' AND pt = 'ED' AND pg = 1 THEN 'ED visit and next-day hospitalization'
    WHEN visit_type = 'ED' AND nt = 'Hospitalization' AND ng = 1 THEN 'ED visit and next-day hospitalization'
    WHEN visit_type = 'ED' AND pt = 'ED' AND pg = 0 THEN 'Multiple same-day ED visits'
    WHEN visit_type = 'ED' AND ng = 0 THEN 'Multiple same-day ED visits'
    WHEN visit_type = 'ED' THEN 'ED visit only' ELSE 'Hospitalization only' END AS visit_category
  FROM placed
)"""

MERGED_SQL = CATEGORIZED_SQL + """,
merged AS (
  SELECT record_id, date, visit_category,
    string_agg(coalesce(visit_reason, 'NA'), '/' ORDER BY visit_type, event_id) AS visit_reason,
    min(admit) AS hospitalization_admit_date, max(discharge) AS hospitalization_discharge_date,
    max(stay) AS hospitalization_length_of_stay_days
  FROM categorized GROUP BY record_id, date, visit_category
)"""

LABELLED_SQL = PANEL_SQL + "," + MERGED_SQL + """,
flagged AS (
  SELECT p.record_id, p.date, p.study_day, m.visit_category, m.visit_reason, m.hospitalization_length_of_stay_days,
    CASE WHEN m.record_id IS NULL THEN 0 ELSE 1 END AS ev,
    CASE WHEN m.visit_category = 'ED visit only' THEN 1 ELSE 0 END AS ed_only,
    CASE WHEN m.visit_category = 'Hospitalization only' THEN 1 ELSE 0 END AS hospital_only,
    CASE WHEN m.visit_category = 'ED visit and same-day hospitalization' THEN 1 ELSE 0 END AS ed_and_hospital
  FROM panel p LEFT JOIN merged m ON p.record_id = m.record_id AND p.date = m.date
),
ended AS (
  SELECT *, CASE WHEN lead(date) OVER w IS NULL OR lead(date) OVER w - date <> 1 THEN date END AS mark
  FROM flagged WINDOW w AS (PARTITION BY record_id ORDER BY date, visit_category NULLS LAST)
),
windowed AS (
  SELECT *,
    first_value(mark IGNORE NULLS) OVER (PARTITION BY record_id ORDER BY date, visit_category NULLS LAST
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - date + 1 AS days_left,
    CASE WHEN sum(ev) OVER (PARTITION BY record_id ORDER BY date
      RANGE BETWEEN CURRENT ROW AND INTERVAL 6 DAY FOLLOWING) >= 1 THEN 1 ELSE 0 END AS incl
  FROM ended
),
unknowns AS (
  SELECT *, CASE WHEN incl = 0 AND days_left < 7 THEN NULL ELSE incl END AS incl_unknown FROM windowed
),
labelled AS (
  SELECT *, lead(incl_unknown) OVER (PARTITION BY record_id ORDER BY date, visit_category NULLS LAST) AS excl_unknown
  FROM unknowns
)"""

RESPONSES_SQL = """
answered AS (
  SELECT user_id AS record_id, event_id, date_trunc('second', ts) AS start_ts, CAST(ts AS DATE) AS date, value AS progress,
    CAST(k % 5 AS DOUBLE) AS pain_sev, CASE WHEN k % 7 <> 6 THEN CAST(k % 7 AS DOUBLE) END AS pain_freq,
    CASE WHEN k % 3 <> 0 THEN CAST(k % 3 AS DOUBLE) END AS nausea_sev,
    CASE WHEN k % 4 <> 0 THEN CAST(k % 4 AS DOUBLE) END AS other_sev, CAST(k AS DOUBLE) AS duration_seconds
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)
),
daily AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY record_id, date ORDER BY start_ts,
      (CASE WHEN pain_sev IS NULL THEN 0 ELSE 1 END) + (CASE WHEN pain_freq IS NULL THEN 0 ELSE 1 END)
      + (CASE WHEN nausea_sev IS NULL THEN 0 ELSE 1 END) + (CASE WHEN other_sev IS NULL THEN 0 ELSE 1 END) DESC, event_id) AS rn
    FROM answered WHERE progress >= 20)
  WHERE rn = 1
)"""

SYMPTOMS_SQL = PANEL_SQL + "," + RESPONSES_SQL + """,
rated AS (
  SELECT record_id, date, greatest(pain_sev, pain_freq) AS pain, nausea_sev AS nausea FROM daily
),
symptoms AS (
  SELECT p.record_id, p.date, p.study_day, r.pain AS pain_raw, r.nausea AS nausea_raw,
    coalesce(r.pain, -1) AS pain_highest_rating, coalesce(r.nausea, -1) AS nausea_highest_rating,
    CASE WHEN r.record_id IS NOT NULL THEN CASE WHEN r.pain IN (2, 3, 4) THEN 1 ELSE 0 END END AS pain_symptom_day,
    CASE WHEN r.record_id IS NOT NULL THEN CASE WHEN r.nausea IN (2, 3, 4) THEN 1 ELSE 0 END END AS nausea_symptom_day
  FROM panel p LEFT JOIN rated r ON p.record_id = r.record_id AND p.date = r.date
)"""

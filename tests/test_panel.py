"""Panel expansion and forward labels against brute force."""

import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dayspan.operators.windows import event_within, run_end
from dayspan.plans.labels import label_windows
from dayspan.plans.panel import expand_panel, panel_from_tables

D = dt.date(2024, 1, 1)


def day(n):
    return None if n is None else D + dt.timedelta(days=n)


def span_days(s, e, xs, xe, offset):
    if s is None or e is None:
        return []
    if xs is not None and xe is not None:
        return list(range(s, xs - offset + 1)) + list(range(xe + offset, e + 1))
    return list(range(s, e + 1))


def expected_panel(spans, offset):
    by_id = {}
    for i, s, e, xs, xe in spans:
        by_id.setdefault(i, []).extend(span_days(s, e, xs, xe, offset))
    rows = []
    for i, days in by_id.items():
        distinct = sorted(set(days))
        rows += [(i, day(d), distinct.index(d), len(distinct)) for d in days]
    return sorted(rows)


def collected(df):
    return sorted((r["id"], r["date"], r["study_day"], r["days_in_study"]) for r in df.collect())


def frame(spark, spans):
    rows = [(i, day(s), day(e), day(xs), day(xe)) for i, s, e, xs, xe in spans]
    return spark.createDataFrame(rows, "id int, s date, e date, xs date, xe date")


B_DATES = [
    (1, 0, 5, None, None), (2, 0, 9, 3, 5), (3, 0, 6, 4, 6), (4, 2, 2, None, None), (5, 0, None, None, None),
    (6, None, 4, None, None), (7, 5, 2, None, None), (8, 0, 9, 3, None), (9, 0, 9, 0, 2), (10, 0, 3, 6, 8), (11, 0, 8, 4, 4),
]


@pytest.mark.parametrize("offset", [0, 1, 2])
@pytest.mark.parametrize("unique", [True, False])
def test_expand_panel(spark, offset, unique):
    df = expand_panel(frame(spark, B_DATES), "id", "s", "e", "xs", "xe", offset, unique_ids=unique)
    assert collected(df) == expected_panel(B_DATES, offset)


bounds = st.one_of(st.none(), st.integers(0, 15))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(bounds, bounds, bounds, bounds), min_size=1, max_size=12), st.integers(0, 2))
def test_expand_panel_properties(spark, spans, offset):
    numbered = [(i, *s) for i, s in enumerate(spans)]
    df = frame(spark, numbered)
    assert collected(expand_panel(df, "id", "s", "e", "xs", "xe", offset, unique_ids=True)) == expected_panel(numbered, offset)


def test_expand_panel_with_several_rows_per_id(spark):
    spans = [(1, 0, 3, None, None), (1, 2, 6, None, None), (2, 0, 1, None, None)]
    assert collected(expand_panel(frame(spark, spans), "id", "s", "e", "xs", "xe", 1)) == expected_panel(spans, 1)


def test_unique_ids_are_not_shuffled(spark):
    df = expand_panel(frame(spark, B_DATES), "id", "s", "e", "xs", "xe", 1, unique_ids=True)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_panel_from_tables_keeps_ids_without_pause(spark):
    dates = spark.createDataFrame([(1, day(0), day(3)), (2, day(0), day(3))], "id int, s date, e date")
    pauses = spark.createDataFrame([(2, day(1), day(1)), (3, day(0), day(2))], "id int, xs date, xe date")
    df = panel_from_tables(dates, pauses, "id", "s", "e", "xs", "xe", 1)
    assert collected(df) == expected_panel([(1, 0, 3, None, None), (2, 0, 3, 1, 1)], 1)


def expected_labels(panel, events, horizon):
    """Row by row: the definition, with no regard to cost."""
    out = []
    for i in sorted({p[0] for p in panel}):
        rows = []
        for d in sorted(p[1] for p in panel if p[0] == i):
            cats = sorted(c for j, e, c in events if j == i and e == d)
            rows += [(d, c) for c in cats] or [(d, None)]
        known = []
        for k, (d, _) in enumerate(rows):
            label = int(any(c is not None and d <= e < d + horizon for e, c in rows))
            end = next(rows[m][0] for m in range(k, len(rows)) if m + 1 == len(rows) or rows[m + 1][0] - rows[m][0] != 1)
            known.append((label, None if label == 0 and end - d + 1 < horizon else label))
        for k, (d, c) in enumerate(rows):
            out.append((i, day(d), c, *known[k], known[k + 1][1] if k + 1 < len(rows) else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_label_windows(spark, seed):
    rng = random.Random(seed)
    panel, events = [], []
    for i in range(8):
        days = [d for d in range(30) if not (10 <= d < 10 + rng.randint(0, 6))][: rng.randint(1, 30)]
        panel += [(i, d) for d in days]
        for d in days:
            if rng.random() < 0.08:
                events += [(i, d, c) for c in rng.sample(["ED visit only", "Hospitalization only", "Multiple same-day ED visits"], rng.randint(1, 2))]
    events.append((0, 400, "ED visit only"))
    p = spark.createDataFrame([(i, day(d), 0) for i, d in panel], "record_id int, date date, study_day int")
    e = spark.createDataFrame([(i, day(d), c) for i, d, c in events], "record_id int, date date, visit_category string")
    label = "unplanned_healthcare_event_within_7days_"
    got = label_windows(p, e).collect()
    rows = [
        (r["record_id"], r["date"], r["visit_category"], r[label + "incl_today"], r[label + "incl_today_with_unknowns"],
         r[label + "excl_today_with_unknowns"])
        for r in got
    ]
    assert sorted(rows, key=str) == expected_labels(panel, [x for x in events if x[1] < 400], 7)
    assert all(r[3] == 0 or r[4] == 1 for r in rows)
    assert all(
        (r["ed_only"], r["hospital_only"]) == (int(r["visit_category"] == "ED visit only"), int(r["visit_category"] == "Hospitalization only"))
        for r in got
    )


def test_label_windows_sorts_once(spark):
    p = spark.createDataFrame([(1, day(0), 0)], "record_id int, date date, study_day int")
    e = spark.createDataFrame([(1, day(0), "ED visit only")], "record_id int, date date, visit_category string")
    plan = label_windows(p, e)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [record_id#") - plan.count("SortMergeJoin") * 2 <= 1
    assert "unboundedfollowing" not in plan.lower()


@pytest.mark.parametrize("today", [True, False])
def test_event_within(spark, today):
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 3), rng.randint(0, 40), int(rng.random() < 0.1)) for i in range(300)]
    df = spark.createDataFrame([(i, k, day(d), f) for i, k, d, f in rows], "row int, id int, date date, flag int")
    got = {r["row"]: r["event_within"] for r in event_within(df, "id", "date", "flag", 7, today).collect()}
    low = 0 if today else 1
    for i, k, d, _ in rows:
        assert got[i] == int(any(f and kk == k and low <= dd - d < low + 7 for _, kk, dd, f in rows))


@pytest.mark.parametrize("bounded", [False, True])
def test_run_end_with_duplicate_days(spark, bounded):
    days = [0, 1, 1, 2, 5, 6, 9]
    df = spark.createDataFrame([(1, day(d), i) for i, d in enumerate(days)], "id int, date date, row int")
    got = {r["row"]: r["run_end"] for r in run_end(df, "id", "date", ["row"], bounded_groups=bounded).collect()}
    assert got == {0: day(1), 1: day(1), 2: day(2), 3: day(2), 4: day(6), 5: day(6), 6: day(9)}


def test_days_in_study(spark):
    df = expand_panel(frame(spark, [(1, 0, 9, 3, 5)]), "id", "s", "e", "xs", "xe", 1, unique_ids=True)
    assert df.agg(F.max("study_day") + 1, F.max("days_in_study")).first() == (7, 7)

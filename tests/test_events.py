"""Slots, visit categories and collapsing."""

import datetime as dt

import pytest

from dayspan.operators.aggregates import collapse_events
from dayspan.operators.reshape import slots_to_long
from dayspan.operators.select import decision_split
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
    merge_adjacent_events,
)
from dayspan.plans.panel import expand_panel

D = dt.date(2024, 3, 1)


def day(n):
    return D + dt.timedelta(days=n)


CASES = {
    1: ([(0, ED), (0, ED)], [MULTIPLE_ED, MULTIPLE_ED]),
    2: ([(0, ED), (0, HOSPITAL)], [SAME_DAY, SAME_DAY]),
    3: ([(0, ED), (1, HOSPITAL)], [NEXT_DAY, NEXT_DAY]),
    4: ([(0, ED), (0, ED), (0, HOSPITAL)], [MULTIPLE_ED, SAME_DAY, SAME_DAY]),
    5: ([(0, HOSPITAL)], [HOSPITAL_ONLY]),
    6: ([(0, ED), (2, HOSPITAL)], [ED_ONLY, HOSPITAL_ONLY]),
    7: ([(0, HOSPITAL), (1, ED)], [HOSPITAL_ONLY, ED_ONLY]),
    8: ([(0, ED), (0, HOSPITAL), (0, HOSPITAL), (1, HOSPITAL)], [SAME_DAY, SAME_DAY, HOSPITAL_ONLY, HOSPITAL_ONLY]),
    9: ([(0, ED), (0, ED), (1, HOSPITAL)], [MULTIPLE_ED, NEXT_DAY, NEXT_DAY]),
}


@pytest.mark.parametrize("bounded", [False, True])
def test_categories(spark, bounded):
    rows = [(k, i, day(d), t) for k, (visits, _) in CASES.items() for i, (d, t) in enumerate(visits)]
    df = spark.createDataFrame(rows, "id int, row int, date date, visit_type string")
    got = {(r["id"], r["row"]): r["visit_category"] for r in categorize_visits(df, "id", tie=["row"], bounded_groups=bounded).collect()}
    for k, (_, expected) in CASES.items():
        assert [got[k, i] for i in range(len(expected))] == expected, k


def test_merge_collapses_per_day_and_category(spark):
    rows = [
        (1, 1, day(0), ED, "fever", "yes", None, None, None),
        (1, 2, day(0), ED, "NA", "yes, again", None, None, None),
        (1, 3, day(0), HOSPITAL, "pain", "yes", day(0), day(4), 4.0),
        (1, 4, day(9), HOSPITAL, "planned", "no", day(9), day(10), 1.0),
        (1, 5, day(12), ED, "x", "maybe", None, None, None),
        (1, 6, day(13), ED, "y", None, None, None, None),
        (2, 7, day(0), ED, None, "yes", None, None, None),
        (2, 8, day(1), HOSPITAL, "z", "yes", day(1), day(2), 1.0),
    ]
    df = spark.createDataFrame(
        rows, "record_id int, row int, date date, visit_type string, visit_reason string, include_yes_no string, "
        "hospitalization_admit_date date, hospitalization_discharge_date date, hospitalization_length_of_stay_days double")
    got = {tuple(r[:3]): tuple(r[3:]) for r in merge_adjacent_events(df, "record_id", ["row"]).collect()}
    assert got == {
        (1, day(0), SAME_DAY): ("NA/pain", day(0), day(4), 4.0),
        (1, day(0), MULTIPLE_ED): ("fever", None, None, None),
        (2, day(0), NEXT_DAY): ("NA", None, None, None),
        (2, day(1), NEXT_DAY): ("z", day(1), day(2), 1.0),
    }
    included, dropped = decision_split(df, "include_yes_no")
    assert sorted(r["row"] for r in included.collect()) == [1, 2, 3, 7, 8]
    assert [r["row"] for r in dropped.collect()] == [4]


WIDE = "record_id int, hosp1_admit_date date, hosp1_reason string, hosp2_admit_date date, hosp2_reason string, " \
       "edvisit1_date date, edvisit1_reason string, age int"


def wide_frame(spark):
    return spark.createDataFrame(
        [
            (1, day(5), "b", day(2), "a", day(2), "e", 50),
            (2, None, "undated", None, None, None, None, 60),
            (3, day(1), None, day(1), "tie", None, None, 70),
        ],
        WIDE,
    )


def test_slots_drop_only_all_null(spark):
    long = slots_to_long(wide_frame(spark), ["record_id"], "hosp(.)_(.*)", "n")
    assert sorted((r["record_id"], r["n"], r["reason"]) for r in long.collect() if r["reason"]) == [
        (1, "1", "b"), (1, "2", "a"), (2, "1", "undated"), (3, "2", "tie")]
    assert long.count() == 5
    with pytest.raises(ValueError):
        slots_to_long(wide_frame(spark), ["record_id"], "nothing(.)_(.*)")


SPECS = [SlotSpec("hosp(.)_(.*)", "admit_date", HOSPITAL, "hospitalization_number"),
         SlotSpec("edvisit(.)_(.*)", "date", ED, "ed_visit_number")]


@pytest.mark.parametrize("bounded", [False, True])
def test_event_log_numbers(spark, bounded):
    log = build_event_log(wide_frame(spark), "record_id", SPECS, bounded_groups=bounded)
    got = sorted((r["record_id"], r["visit_number"], r["visit_type"], r["reason"], r["hospitalization_number"], r["ed_visit_number"])
                 for r in log.collect())
    assert got == [
        (1, 1, HOSPITAL, "a", 1, None), (1, 2, ED, "e", None, 1), (1, 3, HOSPITAL, "b", 2, None),
        (2, 1, HOSPITAL, "undated", 1, None),
        (3, 1, HOSPITAL, None, 1, None), (3, 2, HOSPITAL, "tie", 2, None),
    ]
    panel = spark.createDataFrame([(1, day(2)), (3, day(9))], "record_id int, date date")
    inside = build_event_log(wide_frame(spark), "record_id", SPECS, panel, bounded_groups=bounded)
    assert sorted((r["record_id"], r["visit_number"]) for r in inside.collect()) == [(1, 1), (1, 2)]


@pytest.mark.parametrize("unique", [False, True])
def test_event_log_panel_is_not_broadcast(spark, unique):
    """A panel expanded from few rows looks small to the planner; events match by id and date, unknown ones never."""
    old = dt.date(1969, 12, 31)
    wide = spark.createDataFrame([(1, day(0), "a", day(70), "b"), (1, old, "c", None, "d"), (2, day(400), "e", day(401), "f"), (None, day(0), "g", None, None)],
                                 "record_id int, hosp1_admit_date date, hosp1_reason string, hosp2_admit_date date, hosp2_reason string")
    ranges = [(1, day(0), day(70)), (2, day(0), day(400)), (None, day(0), day(9)), (1, old, old)]
    values = ", ".join(f"(CAST({i or 'NULL'} AS INT), DATE'{a}', DATE'{b}')" for i, a, b in ranges)
    spans = spark.sql(f"SELECT * FROM VALUES {values} AS t(record_id, s, e)")
    panel = expand_panel(spans, "record_id", "s", "e", unique_ids=True)
    log = build_event_log(wide, "record_id", SPECS[:1], panel, bounded_groups=True, unique_days=unique)
    assert "Broadcast" not in log._jdf.queryExecution().executedPlan().toString()
    assert log.columns[:2] == ["record_id", "date"] and len(log.columns) == len(set(log.columns))
    assert sorted((r["record_id"], r["visit_number"], r["reason"]) for r in log.collect()) == [(1, 1, "c"), (1, 2, "a"), (1, 3, "b"), (2, 1, "e")]


def test_event_log_repeats_by_panel_rows(spark):
    panel = spark.createDataFrame([(1, day(2)), (1, day(2))], "record_id int, date date")
    log = build_event_log(wide_frame(spark), "record_id", SPECS, panel, bounded_groups=True)
    assert sorted(r["visit_number"] for r in log.collect()) == [1, 1, 2, 2]


def test_collapse_all_null(spark):
    df = spark.createDataFrame([(1, 2, None, None), (1, 1, "a", None)], "k int, o int, t string, v int")
    row = collapse_events(df, ["k"], "t", ["o"], min_cols=["v"]).first()
    assert (row["t"], row["v"]) == ("a/NA", None)


def test_same_day_order_uses_type_then_tie(spark):
    df = spark.createDataFrame([(1, 2, day(0), HOSPITAL), (1, 1, day(0), ED)], "id int, row int, date date, visit_type string")
    assert {r["visit_category"] for r in categorize_visits(df, "id", tie=["row"]).collect()} == {SAME_DAY}

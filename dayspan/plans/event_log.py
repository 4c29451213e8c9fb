"""Event log from wide slots, and merging of adjacent encounters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from dayspan.operators.aggregates import collapse_events
from dayspan.operators.ordered import following, ordered_scan, previous, running_count, running_sum
from dayspan.operators.reshape import find_slots, slot_values
from dayspan.operators.select import decision_split, null_if

# Encounter types and merged categories.
ED, HOSPITAL = "ED", "Hospitalization"
ED_ONLY = "ED visit only"
HOSPITAL_ONLY = "Hospitalization only"
SAME_DAY = "ED visit and same-day hospitalization"
NEXT_DAY = "ED visit and next-day hospitalization"
MULTIPLE_ED = "Multiple same-day ED visits"


@dataclass(frozen=True)
class SlotSpec:
    """Slots of one event type: name pattern (slot, field), the field with the date, the type and its number."""

    pattern: str
    date_field: str
    event_type: str
    number_col: str


def build_event_log(wide: DataFrame, id_col: str, specs: Sequence[SlotSpec], panel: DataFrame | None = None,
                    tie: Sequence[str] = (), bounded_groups: bool = False, unique_days: bool = False) -> DataFrame:
    """One row per event, numbered per id overall and within its type, restricted to panel days.

    Order is by date (unknown dates last), then by type as listed, then by ``tie``
    and slot. The overall number and the numbers per type come from one sorted pass,
    because a type's order is the overall order restricted to that type.

    An event comes once per panel row of its id and date. ``unique_days`` states that the panel has one row per id
    and date; its days then meet the events as bits, 64 days to a row.
    """
    found = [find_slots(wide, [id_col, *tie], spec.pattern) for spec in specs]
    types: dict[str, DataType] = {}
    for _, fields in found:
        types = {**fields, **types}
    # All slots of all types leave the wide row in one step, so it is read once.
    entries = []
    for rank, (spec, (slots, fields)) in enumerate(zip(specs, found)):
        for slot, members in slots.items():
            known = [F.col(c).isNotNull() for c in members.values()]
            values = {f: v for f, v in zip(types, slot_values(members, types))}
            values["date"] = F.col(members[spec.date_field]) if spec.date_field in members else F.lit(None)
            entry = F.struct(
                *[v.alias(f) for f, v in values.items() if f != "date"], values["date"].cast("date").alias("date"),
                F.lit(spec.event_type).alias("visit_type"), F.lit(rank).alias("_type_rank"), F.lit(slot).alias("_slot"),
            )
            entries.append(F.when(reduce(lambda a, b: a | b, known), entry))
    log = wide.select(id_col, *tie, F.inline(F.array_compact(F.array(*entries))))
    order = ["date", "_type_rank", *tie, "_slot"]
    scans = {"visit_number": running_count()}
    for rank, spec in enumerate(specs):
        scans[spec.number_col] = running_sum((F.col("_type_rank") == rank).cast("bigint"))
    numbered = ordered_scan(log, [id_col], order, scans, bounded_groups)
    numbered = numbered.withColumns(
        {s.number_col: F.when(F.col("_type_rank") == r, F.col(s.number_col)) for r, s in enumerate(specs)}
    ).drop("_slot", "_type_rank", *tie)
    if panel is None:
        return numbered
    # A panel is expanded from few rows, and its plan's size is still theirs: without the hint it would be broadcast.
    if not unique_days:
        return numbered.join(panel.select(id_col, "date").hint("merge"), [id_col, "date"], "inner")
    day = F.unix_date("date")
    span, bit = F.shiftright(day, 6), F.call_function("shiftleft", F.lit(1).cast("bigint"), day.bitwiseAND(63))
    days = panel.select(id_col, span.alias("_span"), bit.alias("_bit")).groupBy(id_col, "_span").agg(
        F.bit_or("_bit").alias("_days")
    )
    inside = numbered.withColumn("_span", span).join(days.hint("merge"), [id_col, "_span"], "inner")
    rest = [c for c in numbered.columns if c not in (id_col, "date")]
    return inside.filter(F.col("_days").bitwiseAND(bit) != 0).select(id_col, "date", *rest)


def categorize_visits(df: DataFrame, id_col: str, date_col: str = "date", type_col: str = "visit_type",
                      tie: Sequence[str] = (), out: str = "visit_category",
                      bounded_groups: bool = False) -> DataFrame:
    """Category of an encounter from its neighbours in (date, type, tie) order; the first rule that holds decides."""
    scans = {
        "_type_before": previous(F.col(type_col)),
        "_date_before": previous(F.col(date_col)),
        "_type_after": following(F.col(type_col)),
        "_date_after": following(F.col(date_col)),
    }
    seen = ordered_scan(df, [id_col], [date_col, type_col, *tie], scans, bounded_groups)
    is_ed, is_hospital = F.col(type_col) == ED, F.col(type_col) == HOSPITAL
    ed_before, hospital_after = F.col("_type_before") == ED, F.col("_type_after") == HOSPITAL
    gap_before = F.datediff(date_col, "_date_before")
    gap_after = F.datediff("_date_after", date_col)
    category = (
        F.when(is_hospital & ed_before & (gap_before == 0), SAME_DAY)
        .when(is_ed & hospital_after & (gap_after == 0), SAME_DAY)
        .when(is_hospital & ed_before & (gap_before == 1), NEXT_DAY)
        .when(is_ed & hospital_after & (gap_after == 1), NEXT_DAY)
        .when(is_ed & ed_before & (gap_before == 0), MULTIPLE_ED)
        .when(is_ed & (gap_after == 0), MULTIPLE_ED)
        .when(is_ed, ED_ONLY)
        .when(F.col(type_col).isNotNull(), HOSPITAL_ONLY)
    )
    return seen.withColumn(out, category).drop(*scans)


def merge_adjacent_events(df: DataFrame, id_col: str, tie: Sequence[str], decision_col: str | None = "include_yes_no",
                          text_cols: Sequence[str] = ("visit_reason", "visit_notes"),
                          reason_col: str = "visit_reason", admit_col: str = "hospitalization_admit_date",
                          discharge_col: str = "hospitalization_discharge_date",
                          stay_col: str = "hospitalization_length_of_stay_days",
                          bounded_groups: bool = False) -> DataFrame:
    """Included encounters, categorized and collapsed to one row per id, day and category.

    An encounter on the day after stays a row of its own, because the day is part of the key.
    """
    cleaned = null_if(df, [c for c in text_cols if c in df.columns])
    included = decision_split(cleaned, decision_col)[0] if decision_col else cleaned
    categorized = categorize_visits(included, id_col, tie=tie, bounded_groups=bounded_groups)
    return collapse_events(
        categorized, [id_col, "date", "visit_category"], reason_col, ["visit_type", *tie],
        min_cols=[admit_col], max_cols=[discharge_col, stay_col],
    )

"""Wide to long, long to wide, and row appends. None of these but the pivot shuffles."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from dayspan.functions.labels import rating_label


def find_slots(df: DataFrame, id_cols: Sequence[str], pattern: str) -> tuple[dict[str, dict[str, str]], dict[str, DataType]]:
    """(column per slot and field, type per field) of the columns that match ``pattern``."""
    slots: dict[str, dict[str, str]] = {}
    types: dict[str, DataType] = {}
    for column in df.schema.fields:
        found = re.fullmatch(pattern, column.name)
        if found and column.name not in id_cols:
            slot, field = found.groups()
            slots.setdefault(slot, {})[field] = column.name
            types[field] = column.dataType
    if not slots:
        raise ValueError(f"no column matches {pattern}")
    return slots, types


def slot_values(members: dict[str, str], types: dict[str, DataType]) -> list[Column]:
    """One value per field; null where the slot has no such column."""
    return [(F.col(members[f]) if f in members else F.lit(None)).cast(t).alias(f) for f, t in types.items()]


def slots_to_long(df: DataFrame, id_cols: Sequence[str], pattern: str, slot_col: str = "slot",
                  drop_all_null: bool = True) -> DataFrame:
    """Turn numbered slots of columns into rows.

    ``pattern`` has two groups, the slot and the field, e.g. ``"hosp(.)_(.*)"``.
    Every field becomes one column; a slot that lacks a field gets null there.
    """
    slots, types = find_slots(df, id_cols, pattern)
    entries = [F.struct(F.lit(s).alias(slot_col), *slot_values(m, types)) for s, m in slots.items()]
    long = df.select(*id_cols, F.inline(F.array(*entries)))
    if drop_all_null:
        long = long.filter(F.coalesce(*[F.col(f).cast("string") for f in types]).isNotNull())
    return long


def melt_ratings(df: DataFrame, id_cols: Sequence[str], value_cols: Sequence[str],
                 name_col: str = "symptom", value_col: str = "highest_rating",
                 label: Callable[[Column], Column] = rating_label) -> DataFrame:
    """One row per rating column with a readable name.

    The names are constants, so their labels are made once by the optimizer and not per row.
    """
    entries = [F.struct(label(F.lit(c)).alias(name_col), F.col(c).alias(value_col)) for c in value_cols]
    return df.select(*id_cols, F.inline(F.array(*entries)))


def pivot_counts(df: DataFrame, keys: Sequence[str], names_from: str, values_from: str,
                 names: Sequence[str]) -> DataFrame:
    """One column per listed name; the list is fixed, so no pass over the data is needed to find it."""
    return df.groupBy(*keys).pivot(names_from, list(names)).agg(F.first(values_from, ignorenulls=True))


def append_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """Append by column name; absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def bind_constants(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Repeat the values of a one-row frame on every row."""
    return df.withColumns({name: F.lit(value) for name, value in values.items()})


def with_header_rows(df: DataFrame, group_cols: Sequence[str], level: Column, level_col: str = "level",
                     number_col: str = "level_number", carry: dict[str, Column] | None = None) -> DataFrame:
    """Add one row per distinct group with level number 0, for section headings.

    ``carry`` holds further columns of the heading rows, computed from the group.
    """
    carry = carry or {}
    heads = df.select(*group_cols, *[c.alias(n) for n, c in carry.items()]).distinct()
    heads = heads.withColumns({level_col: level, number_col: F.lit(0).cast(df.schema[number_col].dataType)})
    return append_rows([df, heads])

"""Categorical values with an ordered list of levels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def recode(value: Column, changes: Mapping[str, str], null_label: str | None = None) -> Column:
    """Replace listed values, keep the others; optionally name nulls."""
    kept = value
    if changes:
        chain = None
        for old, new in changes.items():
            chain = F.when(value == old, new) if chain is None else chain.when(value == old, new)
        kept = chain.otherwise(value)
    return kept if null_label is None else F.coalesce(kept, F.lit(null_label))


def with_levels(value: Column, levels: Sequence[str]) -> Column:
    """The value where it is one of the levels, else null."""
    return F.when(value.isin(*levels), value)


def level_number(value: Column, levels: Sequence[str], start: int = 1) -> Column:
    """Position of the value in the level list; null outside it."""
    position = F.array_position(F.array(*[F.lit(x) for x in levels]), value)
    return F.when(position > 0, position + (start - 1)).cast("bigint")


def levels_with_last(values: Sequence[str], last: str = "Other") -> list[str]:
    """Sorted levels with one of them moved to the end."""
    return sorted(v for v in set(values) if v != last) + [last]

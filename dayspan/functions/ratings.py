"""Ratings, flags and bins."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of the rating attributes, ratings that count as moderate to severe.
RATING_SUFFIXES = ("_sev", "_freq", "_int")
SEVERE_RATINGS = (2, 3, 4)


def in_set(value: Column, members: Sequence) -> Column:
    """Membership where a null is simply not a member."""
    return F.coalesce(value.isin(*members), F.lit(False))


def matches(text: Column, pattern: str) -> Column:
    """Regular expression test where a null does not match."""
    return F.coalesce(text.rlike(pattern), F.lit(False))


def if_else(condition: Column, yes, no) -> Column:
    """Two-way choice that is null where the condition is null."""
    return F.when(condition.isNull(), None).when(condition, yes).otherwise(no)


def count_known(columns: Sequence[str]) -> Column:
    """Number of non-null values among the columns of a row."""
    return reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns], F.lit(0))


def row_max(columns: Sequence[str]) -> Column:
    """Largest non-null value in a row; null if all are null."""
    picked = [F.col(c) for c in columns]
    return picked[0] if len(picked) == 1 else F.greatest(*picked)


def stems(columns: Sequence[str], suffixes: Sequence[str] = RATING_SUFFIXES) -> list[str]:
    """Column names without their attribute suffix, in order of first appearance."""
    ending = "(" + "|".join(re.escape(s) for s in suffixes) + ")$"
    return list(dict.fromkeys(re.sub(ending, "", c) for c in columns))


def row_max_by_stem(columns: Sequence[str], suffixes: Sequence[str] = RATING_SUFFIXES,
                    match: str = "exact") -> dict[str, Column]:
    """Largest rating per stem.

    ``match="exact"`` takes the columns made of the stem and a suffix;
    ``"substring"`` takes every rating column that contains the stem, so that a
    stem which is part of another one also collects the other's ratings.
    """
    if not columns:
        raise ValueError("at least one rating column is needed")
    if match not in ("exact", "substring"):
        raise ValueError("match must be 'exact' or 'substring'")
    if match == "exact":
        members = {s: [c for c in columns if c in {s, *(s + x for x in suffixes)}] for s in stems(columns, suffixes)}
    else:
        members = {s: [c for c in columns if s in c] for s in stems(columns, suffixes)}
    return {stem: row_max(found) for stem, found in members.items()}


def severe_flag(rating: Column, severe: Sequence[int] = SEVERE_RATINGS) -> Column:
    """1 for a moderate-to-severe rating, else 0; an absent rating is 0."""
    return in_set(rating, severe).cast("int")


def yes_no(flag: Column) -> Column:
    return F.when(flag == 0, "No").when(flag == 1, "Yes")


def whole_text(value: Column) -> Column:
    """Whole number as text without a decimal point."""
    return value.cast("bigint").cast("string")


def bin_top(value: Column, cutpoint: int, null_label: str | None = None) -> Column:
    """Counts as text with everything from ``cutpoint`` up in one bin named ``"<cutpoint>+"``."""
    _check_cutpoint(cutpoint)
    below = F.when(value < cutpoint, whole_text(value))
    return F.when(value >= cutpoint, f"{int(cutpoint)}+").otherwise(
        F.coalesce(below, F.lit(null_label)) if null_label is not None else below
    )


def bin_top_levels(cutpoint: int) -> list[str]:
    _check_cutpoint(cutpoint)
    return [str(i) for i in range(int(cutpoint))] + [f"{int(cutpoint)}+"]


def _check_cutpoint(cutpoint) -> None:
    if cutpoint <= 0 or cutpoint % 1 != 0:
        raise ValueError("the cutpoint must be a whole number greater than 0")


# Display text of ratings, lowest to highest.
RATING_LEVELS = ("Unknown", "Not endorsed or 0", "1", "2", "3", "4")


def rating_text(rating: Column) -> Column:
    """Rating for display: null is unknown, -1 (not endorsed) and 0 are one class."""
    return F.when(rating.isNull(), RATING_LEVELS[0]).when(rating.isin(-1, 0), RATING_LEVELS[1]).otherwise(
        whole_text(rating)
    )

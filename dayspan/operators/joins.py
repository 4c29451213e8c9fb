"""Joins: folds over several frames, null-safe keys and membership flags.

Inner, left, semi and anti joins are left to Catalyst, which splits a hot key at
run time (AQE skew join). A full outer join cannot be split that way, so that of two
frames is a left join plus the right rows without a partner, and that of more frames
a chain of left joins onto a spine of all keys. No job runs to choose a plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def left_join_all(frames: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Left join a list of frames onto the first one."""
    return reduce(lambda a, b: a.join(b, list(on), "left"), frames)


def full_join_all(frames: Sequence[DataFrame], on: Sequence[str], within: DataFrame | None = None) -> DataFrame:
    """Full outer join of a list of frames; key columns are merged. ``within`` restricts it to the keys of one more frame.

    A spine holds every key once, and each frame is joined onto it: every frame is read twice, however many there are. With
    ``within`` its keys are the spine, every frame is read once, and keys that no frame knows are dropped at the end. Rows
    with a null among their keys match nothing; they pass through the spine under the number of their frame.
    """
    on, frames = list(on), list(frames)
    if within is None and len(frames) <= 2:
        return reduce(lambda a, b: full_join(a, b, on), frames)
    marked = [f.withColumn("_frame", F.when(_any_null(on), F.lit(i)).otherwise(F.lit(-1))) for i, f in enumerate(frames)]
    if within is None:
        spine = reduce(DataFrame.unionByName, [m.select(*on, "_frame") for m in marked]).distinct()
        joined = reduce(lambda a, b: _keyed_join(a, b, [*on, "_frame"], "left", null_safe=True), marked, spine)
        return joined.drop("_frame")
    spine = within.select(*on).distinct()
    flagged = [f.withColumn(f"_in{i}", F.lit(True)) for i, f in enumerate(frames)]
    joined = reduce(lambda a, b: a.join(b, on, "left"), flagged, spine)
    flags = [f"_in{i}" for i in range(len(frames))]
    return joined.filter(F.coalesce(*flags)).drop(*flags)


def _any_null(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def full_join(left: DataFrame, right: DataFrame, on: Sequence[str], null_safe: bool = False) -> DataFrame:
    """Full outer join with merged keys; ``null_safe`` lets a null key match a null key.

    Columns other than the keys must have distinct names on the two sides.
    """
    on = list(on)
    from_left = _keyed_join(left, right, on, "left", null_safe)
    only_right = _keyed_join(right, left.select(*on).distinct(), on, "left_anti", null_safe)
    return from_left.unionByName(only_right, allowMissingColumns=True)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "full") -> DataFrame:
    """Join in which null keys match null keys."""
    if how in ("full", "outer", "full_outer"):
        return full_join(left, right, on, null_safe=True)
    return _keyed_join(left, right, list(on), how, null_safe=True)


def _keyed_join(left: DataFrame, right: DataFrame, on: list[str], how: str, null_safe: bool) -> DataFrame:
    if not null_safe:
        return left.join(right, on, how)
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in on})
    condition: Column = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in on])
    joined = left.join(renamed, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    keys = {
        "right": lambda k: F.col(f"_r_{k}"),
    }.get(how, F.col)
    rest = [c for c in left.columns if c not in on] + [c for c in right.columns if c not in on]
    return joined.select(*[keys(k).alias(k) for k in on], *rest)


def exists_flag(df: DataFrame, members: DataFrame, on: Sequence[str], out: str,
                yes="Yes", no="No") -> DataFrame:
    """Mark whether the keys of a row occur in ``members``."""
    found = members.select(*on).distinct().withColumn("_found", F.lit(True))
    flag = F.when(F.col("_found"), F.lit(yes)).otherwise(F.lit(no))
    return df.join(found, list(on), "left").withColumn(out, flag).drop("_found")

"""Projections, filters and null handling."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayspan.functions.ratings import matches


def subset_ids(df: DataFrame, id_col: str, ids: DataFrame | range | Sequence, include: bool = True) -> DataFrame:
    """Keep (or drop) the rows whose id is in a set; a null id is in no set.

    A DataFrame of ids becomes a semi or anti join, a ``range`` a pair of bounds
    that reach the scan, a short sequence a list test.
    """
    if isinstance(ids, DataFrame):
        members = ids.select(F.col(ids.columns[0]).alias(id_col)).distinct()
        return df.join(members, id_col, "left_semi" if include else "left_anti")
    value = F.col(id_col)
    if isinstance(ids, range) and ids.step == 1 and len(ids):
        inside = value.between(ids[0], ids[-1]) & (value == value.cast("bigint"))
    elif len(ids):
        inside = value.isin(*ids)
    else:
        inside = F.lit(False)
    return df.filter(inside) if include else df.filter(~F.coalesce(inside, F.lit(False)))


def cols_like(df: DataFrame, starts: str | None = None, ends: str | None = None,
              contains: str | None = None, regex: str | None = None) -> list[str]:
    """Column names that satisfy every given test. All but ``regex`` ignore case."""
    def keep(name: str) -> bool:
        low = name.lower()
        return (
            (starts is None or low.startswith(starts.lower()))
            and (ends is None or low.endswith(ends.lower()))
            and (contains is None or contains.lower() in low)
            and (regex is None or re.search(regex, name) is not None)
        )

    return [c for c in df.columns if keep(c)]


def rename_by_mapping(df: DataFrame, mapping: Mapping[str, str] | None) -> DataFrame:
    """Rename columns; every old name must exist."""
    if not mapping:
        raise ValueError("a mapping from current to new column names is needed")
    missing = sorted(set(mapping) - set(df.columns))
    if missing:
        raise ValueError(f"columns to rename are missing: {missing}")
    return df.withColumnsRenamed(dict(mapping))


def mapping_from_frame(mapping: DataFrame, columns: Iterable[str], current: str = "current_column_name",
                       new: str = "new_column_name") -> dict[str, str]:
    """Name mapping held in a table, restricted to the given columns (so bounded by the schema)."""
    rows = mapping.filter(F.col(current).isin(*columns)).select(current, new).distinct().collect()
    found = {r[current]: r[new] for r in rows}
    if len(found) != len(rows):
        raise ValueError("a column is mapped to more than one new name")
    return found


def across(df: DataFrame, cols: Sequence[str], f: Callable[[Column], Column],
           name: Callable[[str], str] = lambda c: c) -> DataFrame:
    """Apply one expression to many columns in a single projection."""
    return df.withColumns({name(c): f(F.col(c)) for c in cols})


def decision_flag(text: Column, yes: str = "^yes", no: str = "^no") -> Column:
    """1 / 0 / null from the start of a free-text decision."""
    return F.when(matches(text, yes), 1).when(matches(text, no), 0)


def decision_split(df: DataFrame, col: str, out: str = "include") -> tuple[DataFrame, DataFrame]:
    """(included, dropped) rows by a free-text decision; undecided rows are in neither."""
    flagged = df.withColumn(out, decision_flag(F.col(col)))
    return flagged.filter(F.col(out) == 1), flagged.filter(F.col(out) == 0)


def null_if(df: DataFrame, cols: Sequence[str], value: str = "NA") -> DataFrame:
    """Replace a marker text by null."""
    return across(df, cols, lambda c: F.nullif(c, F.lit(value)))


def fill_nulls(df: DataFrame, cols: Sequence[str], value) -> DataFrame:
    return across(df, cols, lambda c: F.coalesce(c, F.lit(value)))


def complete_cases(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows without a null in the given columns (default: all)."""
    return df.dropna("any", subset=list(cols) if cols else df.columns)


def select_significant(results: DataFrame, p_type: str = "wald", threshold: float = 0.1,
                       regex: str = "symptom_day$", predictor: str = "predictor") -> DataFrame:
    """Distinct predictors with an odds ratio of at least 1 and a p value below the threshold."""
    chosen = matches(F.col(predictor), regex) & (F.col("or") >= 1) & (F.col(f"{p_type}_p_value") < threshold)
    return results.filter(chosen).select(predictor).distinct()


def relocate(df: DataFrame, col: str, after: str | None = None) -> DataFrame:
    """Move a column behind another one, or to the front."""
    rest = [c for c in df.columns if c != col]
    at = rest.index(after) + 1 if after else 0
    return df.select(*rest[:at], col, *rest[at:])

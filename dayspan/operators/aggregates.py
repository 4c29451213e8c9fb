"""Counts, shares and cohort summaries. All are combined on the map side before any shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayspan.functions.levels import with_levels


def freq(df: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def freq_with_share(df: DataFrame, group: str, value: str, subset: Sequence[str] = ()) -> DataFrame:
    """Counts per (group, value) with the share of the group and the share of a subset of values.

    The totals run over the counted rows, one per (group, value), not over the data.
    """
    within = Window.partitionBy(group)
    counted = freq(df, [group, value]).withColumn("total_n", F.sum("n").over(within))
    counted = counted.withColumn("percent", F.round(F.col("n") / F.col("total_n") * 100, 2))
    if not subset:
        return counted
    part = F.sum(F.when(F.col(value).isin(*subset), F.col("n")).otherwise(0)).over(within)
    return counted.withColumn("subset_n", part).withColumn(
        "subset_percent", F.round(F.col("subset_n") / F.col("total_n") * 100, 2)
    )


def collapse_rare(df: DataFrame, col: str, min_n: int = 10, other: str = "Other", out: str | None = None) -> DataFrame:
    """Put categories with fewer than ``min_n`` rows (the null category too) into one.

    The sizes are counted first and joined back, so that a category that holds most
    of the rows is never gathered in one place.
    """
    sizes = df.groupBy(F.col(col).alias("_category")).agg((F.count(F.lit(1)) < min_n).alias("_rare"))
    joined = df.join(sizes, F.col(col).eqNullSafe(F.col("_category")), "left")
    value = F.when(F.col("_rare"), F.lit(other)).otherwise(F.col(col))
    return joined.withColumn(out or col, value).drop("_category", "_rare")


def collapse_events(df: DataFrame, keys: Sequence[str], text_col: str, order: Sequence[str],
                    min_cols: Sequence[str] = (), max_cols: Sequence[str] = (), separator: str = "/") -> DataFrame:
    """One row per key: texts joined in order (a null reads "NA"), minima and maxima of other columns.

    The joined text is part of the result, so a result row is as long as its group's texts.
    """
    entry = F.struct(*[F.col(c) for c in order], F.coalesce(F.col(text_col), F.lit("NA")).alias("_text"))
    texts = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["_text"])
    return df.groupBy(*keys).agg(
        F.array_join(texts, separator).alias(text_col),
        *[F.min(c).alias(c) for c in min_cols],
        *[F.max(c).alias(c) for c in max_cols],
    )


OVERALL, UNKNOWN = "Overall", "Unknown"


@dataclass(frozen=True)
class FoundLevels:
    """Levels of a column that are read from its values, sorted; ``last`` is a level that ends the list, found or not."""

    last: str | None = None


def summarize_columns(df: DataFrame, continuous: Sequence[str] = (),
                      categorical: Mapping[str, Sequence[str] | FoundLevels] | None = None,
                      by: str | None = None, add_overall: bool = False, missing: bool = True) -> DataFrame:
    """Summary of continuous and categorical columns.

    A continuous variable gives one row per stratum: known and missing count, mean,
    sample sd, minimum, maximum. A categorical one gives one row per level and stratum,
    in level order and with empty levels: count and percentage of the known values.
    Its missing values (and values that are no level) form a row "Unknown" unless
    ``missing`` is false or there are none. ``FoundLevels`` takes the levels that occur.
    ``by`` names the strata; ``add_overall`` adds the stratum "Overall", merged from the
    strata's results. Rows are only read to be counted or summed within their stratum.
    """
    parts = []
    if continuous:
        parts.append(_moments(df, continuous, by, add_overall))
    if categorical:
        parts.append(_level_shares(df, categorical, by, add_overall, missing))
    return reduce(DataFrame.unionByName, parts)


def _moments(df: DataFrame, columns: Sequence[str], by: str | None, add_overall: bool) -> DataFrame:
    """One wide aggregate per stratum (count, mean, sum of squares about it, range), laid out into rows afterwards."""
    stratum = F.col(by) if by else F.lit(OVERALL)
    x = [F.col(c).cast("double") for c in columns]
    wide = df.groupBy(stratum.alias("stratum")).agg(F.count(F.lit(1)).alias("rows"), *[
        F.struct(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"), F.min(v).alias("min"),
                 F.max(v).alias("max")).alias(f"_{i}") for i, v in enumerate(x)])
    scopes = [OVERALL] if by and add_overall else []
    layout = [(1, i, c, scope) for i, c in enumerate(columns) for scope in [None, *scopes]]
    # As many rows as the result has: strata by variables, each variable once more for the overall row.
    names = df.sparkSession.createDataFrame(layout, "_all int, _at int, variable string, _scope string")
    rows = wide.withColumn("_all", F.lit(1)).join(names, "_all").select(
        "variable", F.coalesce("_scope", "stratum").alias("stratum"), F.col("_scope").isNotNull().alias("_merged"), "rows",
        F.get(F.array(*[F.col(f"_{i}") for i in range(len(columns))]), F.col("_at")).alias("m"),
    ).select("variable", "stratum", "_merged", "rows", "m.*")
    if scopes:
        # Sums of squares add up once each mean's distance from the common mean is added.
        group = Window.partitionBy("variable", "stratum", "_merged")
        common = F.sum(F.col("n") * F.col("mean")).over(group) / F.nullif(F.sum("n").over(group), F.lit(0))
        apart = rows.withColumn("_common", common)
        rows = apart.groupBy("variable", "stratum", "_merged").agg(
            F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.max("_common").alias("mean"),
            F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("_common"), 2)).alias("m2"),
            F.min("min").alias("min"), F.max("max").alias("max"))
    return rows.select(
        "variable", "stratum", "n", (F.col("rows") - F.col("n")).alias("n_missing"), "mean",
        F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).alias("sd"), "min", "max",
        F.lit(None).cast("string").alias("level"), F.lit(None).cast("bigint").alias("level_number"),
        F.lit(None).cast("double").alias("percent"))


def _level_shares(df: DataFrame, categorical: Mapping[str, Sequence[str] | FoundLevels], by: str | None, add_overall: bool,
                  missing: bool) -> DataFrame:
    """Counts per variable, level and stratum, laid out over the levels; from the counts on, all rows are few."""
    def level_of(name: str, levels: Sequence[str] | FoundLevels) -> Column:
        value = F.col(name).cast("string")
        return value if isinstance(levels, FoundLevels) else with_levels(value, levels)

    entries = [F.struct(F.lit(c).alias("variable"), level_of(c, lv).alias("level")) for c, lv in categorical.items()]
    stratum = F.col(by) if by else F.lit(OVERALL)
    cell = ["variable", "level", "stratum"]
    counted = df.select(stratum.alias("stratum"), F.inline(F.array(*entries))).groupBy(*cell).agg(F.count(F.lit(1)).alias("rows"))
    if by and add_overall:
        counted = counted.groupingSets([[F.col(c) for c in cell], [F.col(c) for c in cell[:2]]], *cell).agg(
            F.sum("rows").alias("rows"), (F.grouping("stratum") == 1).alias("_merged"))
    else:
        counted = counted.withColumn("_merged", F.lit(False))
    found = F.collect_set("level").over(Window.partitionBy("variable"))
    level, rows = F.col("level"), F.col("rows")
    # The counts of a cell as a map no longer than the level list; laid out over the list, zero cells appear.
    cells = counted.withColumn("_found", found).groupBy("variable", "stratum", "_merged").agg(
        F.map_from_entries(F.collect_list(F.when(level.isNotNull(), F.struct(level, rows)))).alias("_counts"),
        F.sum(F.when(level.isNotNull(), rows)).alias("_in_levels"),
        F.sum(F.when(level.isNull(), rows)).alias("_outside"),
        F.first("_found").alias("_found"),
    )
    listed = F.lit(None).cast("array<string>")
    for name, levels in categorical.items():
        if not isinstance(levels, FoundLevels):
            own = F.array(*[F.lit(v) for v in levels]).cast("array<string>")
        else:
            own = F.array_sort("_found")
            if levels.last is not None:
                own = F.concat(F.filter(own, lambda v: v != levels.last), F.array(F.lit(levels.last)))
        listed = F.when(F.col("variable") == name, own).otherwise(listed)

    def entry(name: Column, number: Column, n: Column, share: Column) -> Column:
        return F.struct(name.alias("level"), number.cast("bigint").alias("level_number"), n.cast("bigint").alias("n"), share.alias("percent"))

    n_in = F.col("_in_levels")
    in_level = lambda v: F.coalesce(F.element_at("_counts", v), F.lit(0))
    laid_out = F.transform("_levels", lambda v, i: entry(v, i + 1, in_level(v), F.when(n_in > 0, in_level(v) / n_in * 100)))
    if missing:
        rest = entry(F.lit(UNKNOWN), F.size("_levels") + 1, F.col("_outside"), F.lit(None).cast("double"))
        laid_out = F.when(F.col("_outside").isNotNull(), F.concat(laid_out, F.array(rest))).otherwise(laid_out)
    shown = F.when(F.col("_merged"), F.lit(OVERALL)).otherwise(F.col("stratum"))
    no_moments = {c: F.lit(None).cast("double") for c in ("mean", "sd", "min", "max")} | {"n_missing": F.lit(None).cast("bigint")}
    return cells.withColumn("_levels", listed).select("variable", shown.alias("stratum"), F.inline(laid_out)).withColumns(
        no_moments).select("variable", "stratum", "n", "n_missing", "mean", "sd", "min", "max", "level", "level_number", "percent")


def summarize_continuous(df: DataFrame, cols: Sequence[str], by: str | None = None,
                         add_overall: bool = False) -> DataFrame:
    """Continuous part of ``summarize_columns``."""
    return summarize_columns(df, cols, None, by, add_overall).drop("level", "level_number", "percent")


def summarize_categorical(df: DataFrame, levels: Mapping[str, Sequence[str] | FoundLevels], by: str | None = None,
                          add_overall: bool = False, missing: bool = True) -> DataFrame:
    """Categorical part of ``summarize_columns``."""
    summary = summarize_columns(df, (), levels, by, add_overall, missing)
    return summary.select("variable", "level", "level_number", "stratum", "n", "percent")


def level_counts(df: DataFrame, col: str, levels: Sequence[str]) -> DataFrame:
    """Rows per level, empty levels included."""
    rows = [(v, i) for i, v in enumerate(levels, start=1)]
    frame = df.sparkSession.createDataFrame(rows, "level string, level_number bigint")
    counted = df.groupBy(F.col(col).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("n_per_level"))
    return frame.join(counted, "level", "left").withColumn(
        "n_per_level", F.coalesce("n_per_level", F.lit(0).cast("bigint"))
    )


def cluster_counts(df: DataFrame, id_col: str) -> DataFrame:
    """Number of distinct clusters and of rows."""
    per_cluster = freq(df, [id_col])
    return per_cluster.agg(
        F.count(F.col(id_col)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_obs")
    )

"""Tests of association between a variable and a grouping column."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayspan.functions.tails import chi_square_tail, normal_tail
from dayspan.operators.ordered import block_count


def chi_square(df: DataFrame, by: str, categorical: Sequence[str]) -> DataFrame:
    """Pearson chi-square per variable from one crosstab of all variables; rows with a null are left out.

    Windows run over the crosstab, whose size is levels times groups.
    """
    long = df.filter(F.col(by).isNotNull()).select(
        F.col(by).alias("_by"), *[F.col(c).cast("string").alias(c) for c in categorical]
    ).unpivot(["_by"], list(categorical), "variable", "level")
    cells = long.filter(F.col("level").isNotNull()).groupBy("variable", "level", "_by").agg(F.count(F.lit(1)).alias("o"))
    margins = cells.withColumns(
        {
            "r": F.sum("o").over(Window.partitionBy("variable", "level")),
            "c": F.sum("o").over(Window.partitionBy("variable", "_by")),
            "t": F.sum("o").over(Window.partitionBy("variable")),
        }
    )
    expected = F.col("r") * F.col("c") / F.col("t")
    # A cell without rows adds its expected count, so sum((o-e)^2/e) = sum(o^2/e) - t.
    return (
        margins.groupBy("variable")
        .agg(
            (F.sum(F.col("o") * F.col("o") / expected) - F.max("t")).alias("statistic"),
            ((F.countDistinct("level") - 1) * (F.countDistinct("_by") - 1)).cast("bigint").alias("df"),
            F.max("t").alias("n"),
        )
        .withColumn("p_value", chi_square_tail(F.col("statistic"), F.col("df")))
        .withColumn("test", F.lit("chi-square"))
    )


_COUNTS = "variable string, value double, grp string, t bigint"
_RANGES = "variable string, low double, n bigint, groups array<struct<grp: string, n: bigint, ranks: double, ties: double>>"


def _value_counts(continuous: Sequence[str]):
    """Counts of each value by group within a batch, so that a frequent value is one row of every batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, name in enumerate(continuous, start=1):
                values = pc.add(batch.column(i), 0.0)  # no negative zero
                rows = pa.table({"grp": batch.column(0), "value": values}).filter(values.is_valid())
                found = rows.group_by(["grp", "value"]).aggregate([([], "count_all")])
                yield from pa.table({
                    "variable": pa.array([name] * len(found), pa.string()), "value": found["value"], "grp": found["grp"],
                    "t": found["count_all"],
                }).to_batches()

    return count


def _range_ranks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per variable from the sorted counts of a range of values: rank sums by group, with ranks from 1 in the range."""
    open_value: pd.DataFrame | None = None
    ranges: dict[str, dict] = {}

    def close(counts: pd.DataFrame) -> None:
        counts = counts.groupby(["variable", "value", "grp"], sort=True, dropna=False, as_index=False)["t"].sum()
        for variable, part in counts.groupby("variable", sort=False):
            known = ranges.setdefault(variable, {"low": part["value"].iloc[0], "n": 0, "ties": 0.0, "groups": {}})
            per_value = part.groupby("value", sort=True, dropna=False)["t"].sum()
            upto = known["n"] + per_value.cumsum()
            rank = (upto - (per_value - 1) / 2).to_numpy(dtype=float)
            at = part.groupby("value", sort=True, dropna=False).ngroup().to_numpy()
            part = part.assign(ranks=part["t"].to_numpy(dtype=float) * rank[at])
            for grp, (n, ranks) in part.groupby("grp")[["t", "ranks"]].sum().iterrows():
                before = known["groups"].get(grp, (0, 0.0))
                known["groups"][grp] = (before[0] + int(n), before[1] + ranks)
            t = per_value.to_numpy(dtype=float)
            known["ties"] += float((t**3 - t).sum())
            known["n"] = int(upto.iloc[-1])

    for batch in batches:
        if open_value is not None:
            batch = pd.concat([open_value, batch], ignore_index=True)
        if not len(batch):
            continue
        last = batch.iloc[-1]
        same = (batch["variable"] == last["variable"]) & ((batch["value"] == last["value"]) | (batch["value"].isna() & pd.isna(last["value"])))
        open_value = batch[same]
        if not same.all():
            close(batch[~same])
    if open_value is not None:
        close(open_value)
    yield pd.DataFrame({
        "variable": list(ranges), "low": [r["low"] for r in ranges.values()], "n": [r["n"] for r in ranges.values()],
        # The ties of the range stand at its first group.
        "groups": [[{"grp": g, "n": n, "ranks": s, "ties": 0.0 if i else r["ties"]} for i, (g, (n, s)) in enumerate(r["groups"].items())]
                   for r in ranges.values()],
    }, columns=["variable", "low", "n", "groups"])


def rank_sum(df: DataFrame, by: str, continuous: Sequence[str]) -> DataFrame:
    """Wilcoxon rank-sum test per variable for a grouping column with two values.

    Values are counted by group in each batch, the counts are sorted by ranges of values (one exchange; equal values stay
    together), and each range is reduced to its rank sums. The rows in the ranges before shift those, so no task sees more
    than a range and no job runs to choose splitters but Spark's own sample. Normal approximation with tie and continuity
    correction; W belongs to the group that sorts first.
    """
    columns = [F.col(by).cast("string").alias("grp"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(continuous)]]
    counts = df.select(*columns).filter("grp IS NOT NULL").mapInArrow(_value_counts(list(continuous)), _COUNTS)
    sorted_counts = counts.repartitionByRange(block_count(df), "variable", "value").sortWithinPartitions("variable", "value")
    ranges = sorted_counts.mapInPandas(_range_ranks, _RANGES)
    # One row per variable and range.
    before = Window.partitionBy("variable").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    shifted = ranges.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    groups = shifted.select("variable", "before", F.inline("groups")).groupBy("variable", "grp").agg(
        F.sum("n").cast("double").alias("n"), F.sum(F.col("ranks") + F.col("before") * F.col("n")).alias("ranks"), F.sum("ties").alias("ties"))
    sums = groups.groupBy("variable").agg(
        F.min_by(F.struct("n", "ranks"), "grp").alias("first"), F.sum("n").alias("n_all"), F.sum("ties").alias("ties"),
        F.count(F.lit(1)).alias("n_groups"))
    n_a, n_all = F.col("first")["n"], F.col("n_all")
    n_b = n_all - n_a
    w = F.col("first")["ranks"] - n_a * (n_a + 1) / 2
    spread = F.sqrt(n_a * n_b / 12 * ((n_all + 1) - F.try_divide(F.col("ties"), n_all * (n_all - 1))))
    centred = w - n_a * n_b / 2
    # A constant variable, one group or one row has no spread: no statistic rather than a division by zero.
    z = F.try_divide(centred - F.signum(centred) * 0.5, spread)
    checked = F.when(F.col("n_groups") > 2, F.raise_error(F.lit(f"{by} has more than two values")).cast("double")).otherwise(w)
    return sums.select(
        "variable", F.when(spread > 0, checked).alias("statistic"), z.alias("z"), n_all.cast("bigint").alias("n")
    ).withColumn("p_value", normal_tail(F.col("z"))).withColumn("test", F.lit("rank-sum"))


def compare_groups(df: DataFrame, by: str, continuous: Sequence[str] = (), categorical: Sequence[str] = ()) -> DataFrame:
    """One test per variable: chi-square for categorical, rank-sum for continuous variables."""
    parts = []
    if categorical:
        parts.append(chi_square(df, by, categorical).select(
            "variable", "test", "statistic", F.col("df"), "n", "p_value"))
    if continuous:
        parts.append(rank_sum(df, by, continuous).select(
            "variable", "test", "statistic", F.lit(None).cast("bigint").alias("df"), "n", "p_value"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


# Largest total the table sampler of numpy accepts, and most cells sent to a task.
_SAMPLER_LIMIT = 10**9
_CELL_LIMIT = 10_000


def permutation_test(df: DataFrame, a: str, b: str, replicates: int = 2000, seed: int = 1) -> DataFrame:
    """Independence test with a simulated p value, for sparse tables.

    Tables with the observed margins are drawn at random and compared by their
    probability. Only the margins of the crosstab are needed for that, so the cost of
    a replicate does not grow with the rows; Spark spreads the replicates.
    """
    crosstab = (
        df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
        .groupBy(F.col(a).alias("_a"), F.col(b).alias("_b"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # One row more than the limit tells whether the table is small enough to be collected.
    cells = crosstab.limit(_CELL_LIMIT + 1).collect()
    if len(cells) > _CELL_LIMIT:
        raise ValueError("the columns have too many distinct pairs for a table test; use compare_groups")
    rows: dict = {}
    columns: dict = {}
    for cell in cells:
        rows[cell["_a"]] = rows.get(cell["_a"], 0) + cell["n"]
        columns[cell["_b"]] = columns.get(cell["_b"], 0) + cell["n"]
    if sum(rows.values()) >= _SAMPLER_LIMIT:
        raise ValueError("the table sampler is limited to 1e9 rows; use compare_groups, which has no such limit")
    row_sums, column_sums = sorted(rows.values()), sorted(columns.values())
    observed = -sum(math.lgamma(cell["n"] + 1) for cell in cells)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def log_factorials(counts: np.ndarray) -> float:
            return sum(math.lgamma(n + 1) for n in counts.tolist())

        for batch in batches:
            hits = np.zeros(len(batch), dtype=bool)
            for i, replicate in enumerate(batch["id"]):
                rng = np.random.default_rng([seed, int(replicate)])
                left, total = np.array(column_sums, dtype=np.int64), 0.0
                for size in row_sums[:-1]:
                    drawn = rng.multivariate_hypergeometric(left, size, method="marginals")
                    left = left - drawn
                    total -= log_factorials(drawn)
                total -= log_factorials(left)
                hits[i] = total <= observed + 1e-7
            yield pd.DataFrame({"hit": hits.astype("int64")})

    parallelism = df.sparkSession.sparkContext.defaultParallelism
    drawn = df.sparkSession.range(0, replicates, 1, min(replicates, parallelism)).mapInPandas(draw, "hit bigint")
    return drawn.agg(
        F.count(F.lit(1)).alias("replicates"),
        ((F.sum("hit") + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"),
    )

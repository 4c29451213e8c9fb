"""Tail probabilities (Spark SQL has no error or gamma function).

Meant for rows of results, one per test or coefficient; both forms sum short series.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_ROOT_PI = math.sqrt(math.pi)


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, as a Column."""
    double = F.lit(0.0)
    # erf(x) = 2/sqrt(pi) exp(-x^2) sum of x (2x^2)^k / (1 3 5 ... (2k+1)): positive terms, good for small x.
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(80)),
        F.struct(x.alias("term"), x.alias("total")),
        lambda acc, k: F.struct(
            (acc["term"] * 2 * x * x / (2 * k + 1)).alias("term"),
            (acc["total"] + acc["term"] * 2 * x * x / (2 * k + 1)).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    # erfc(x) = exp(-x^2)/sqrt(pi) / (x + (1/2)/(x + (2/2)/(x + ...))), good for larger x.
    fraction = F.aggregate(F.sequence(F.lit(120), F.lit(1), F.lit(-1)), double, lambda acc, k: (k / 2) / (x + acc))
    bell = F.exp(-x * x) / _ROOT_PI
    return F.when(x < 2, 1 - 2 * bell * series).otherwise(bell / (x + fraction))


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution."""
    return erfc(F.abs(z) / math.sqrt(2))


def chi_square_tail(statistic: Column, df: Column) -> Column:
    """P(X > statistic) for chi-square with a whole number of degrees of freedom.

    Starts at one or two degrees of freedom and adds h^k e^-h / k! (h half the
    statistic) for every two more; terms are kept as logarithms.
    """
    half = F.greatest(statistic, F.lit(0.0)) / 2
    odd = df % 2 == 1
    log_half = F.log(half)
    start = F.when(odd, erfc(F.sqrt(half))).otherwise(F.exp(-half))
    first_k = F.when(odd, 0.5).otherwise(1.0)
    first = F.when(odd, 0.5 * log_half - half - math.lgamma(1.5)).otherwise(log_half - half)
    more = F.floor((df - 1) / 2).cast("int")
    added = F.aggregate(
        F.sequence(F.lit(1), more),
        F.struct(first.alias("log_term"), first_k.alias("k"), F.lit(0.0).alias("total")),
        lambda acc, _: F.struct(
            (acc["log_term"] + log_half - F.log(acc["k"] + 1)).alias("log_term"),
            (acc["k"] + 1).alias("k"),
            (acc["total"] + F.exp(acc["log_term"])).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    tail = F.when((more < 1) | (half == 0), start).otherwise(start + added)
    return F.when(statistic.isNotNull() & (df >= 1), F.least(tail, F.lit(1.0)))


def chi2_tail(statistic: float | None, df: int | None) -> float | None:
    """The same for one number on the driver."""
    if statistic is None or df is None or math.isnan(statistic) or df < 1:
        return None
    half = max(statistic, 0.0) / 2
    if math.isinf(half):
        return 0.0
    tail, k = (math.erfc(math.sqrt(half)), 0.5) if df % 2 else (math.exp(-half), 1.0)
    while k < df / 2 and half > 0:
        tail += math.exp(k * math.log(half) - half - math.lgamma(k + 1))
        k += 1
    return min(tail, 1.0)

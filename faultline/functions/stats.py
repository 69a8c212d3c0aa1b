"""Interval and rank statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: half the width of a 95 % interval, in standard deviations.
Z = 1.96


def ratio(n, d) -> Column:
    """n / d, zero for nothing out of nothing."""
    return F.when(d == 0, 0.0).otherwise(n / d)


def wilson(n, total) -> tuple[Column, Column]:
    """Ends of the 95 % Wilson interval of n out of total, as they come, rounding may lead past 0 and 1; (0, 0) of none."""
    p, n2 = n / total, Z * Z / total
    mid, half = (p + n2 / 2) / (1 + n2), Z / (1 + n2) * F.sqrt(p * (1 - p) / total + n2 / (4 * total))
    return F.when(total == 0, 0.0).otherwise(mid - half), F.when(total == 0, 0.0).otherwise(mid + half)


def odds_ratio(a, b, c, d) -> tuple[Column, Column, Column]:
    """Odds ratio of a 2 x 2 table, each cell plus a half, with its 95 % interval."""
    a, b, c, d = (x + F.lit(0.5) for x in (a, b, c, d))
    log, half = F.log(a * d / (b * c)), Z * F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return F.exp(log), F.exp(log - half), F.exp(log + half)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: rho, NaN where a side is constant or there are fewer than two pairs.

    Ranks come from the counts of distinct values, so no window holds all rows.
    """
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))

    def ranks(c: str) -> DataFrame:
        counts = pairs.groupBy(c).agg(F.count("*").alias("n"))
        below = F.coalesce(F.sum("n").over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return counts.select(c, (below + (F.col("n") + 1) / 2).alias(f"r{c}"))

    ranked = pairs.join(ranks("x"), "x").join(ranks("y"), "y")
    return ranked.agg(F.when((F.count("*") > 1) & (F.stddev_pop("rx") > 0) & (F.stddev_pop("ry") > 0), F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry"))).otherwise(float("nan")).alias("rho"))

"""Score arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sigmoid(v: Column, temperature: float = 1.0) -> Column:
    """of v / T, clamped at 700."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), v / temperature))))


def minmax(v: Column, *by: str) -> Column:
    """Scaled to 0..1 inside a query; a constant pool is all 0."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(v).over(w), F.max(v).over(w)
    return F.when(hi <= lo, F.lit(0.0)).otherwise((v - lo) / F.when(hi > lo, hi - lo))


def blend(alpha: Column | float, learned: Column, lexical: Column) -> Column:
    """F24."""
    a = F.lit(alpha) if isinstance(alpha, float) else alpha
    return a * learned + (1 - a) * lexical


def margin(z0: Column, z1: Column) -> Column:
    """F25."""
    return z0 - z1


def nearest_rank(values: Column, share: float) -> Column:
    """The element at index int(share * n) of the sorted values (not interpolated)."""
    ordered = F.array_sort(values)
    at = F.least(F.floor(F.lit(share) * F.size(ordered)).cast("int"), F.size(ordered) - 1)
    return F.element_at(ordered, at + 1)


def rank_quantiles(rows: DataFrame, value: str, shares: dict[str, float], *by: str) -> DataFrame:
    """A21, Q7 for groups of any size: per group the value at index int(share * n) of the sorted values, and the largest as ``max``.

    Values are counted first; a running sum over distinct values places the
    ranks, so no group's rows are gathered.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(*by)
    placed = counts.withColumn("_upto", F.sum("_c").over(group.orderBy(value))).withColumn("_n", F.sum("_c").over(group))
    at = lambda share: F.least(F.floor(F.lit(share) * F.col("_n")), F.col("_n") - 1)
    return placed.groupBy(*by).agg(*(F.min(F.when(F.col("_upto") > at(share), F.col(value))).alias(name) for name, share in shares.items()), F.max(value).alias("max"))

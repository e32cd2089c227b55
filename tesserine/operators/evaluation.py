"""Percentiles without interpolation, and ratios with a guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def percentiles(values: DataFrame, group: str, value: str, share: float) -> DataFrame:
    """(group, n, percentile): the element at floor((n - 1) * share) of each group's sorted values; nulls are left out.

    Values are counted before they are ordered, so a group costs as many rows as it has different values.
    """
    counts = values.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(W.partitionBy(group).orderBy(value))
    n = F.sum("_c").over(W.partitionBy(group))
    placed = counts.withColumns({"_upto": upto, "n": n}).filter(F.col("_upto") > F.floor((F.col("n") - 1) * F.lit(share)))
    return placed.groupBy(group, "n").agg(F.min(value).alias("percentile"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))

"""Positions and running totals without a single-task window: totals of ranges first, then inside each range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Ids that share a range.
RANGE = 1 << 16


def running_total(df: DataFrame, key: str, value: str, out: str, group: str | None = None, width: int = RANGE) -> DataFrame:
    """Adds out: the sum of value over rows of the same group with a smaller key (keys unique in a group).

    Ranges of width keys are summed first; only those sums, one row for each range, are run over in order."""
    d = df.withColumn("_range", F.floor(F.col(key) / width).cast("long"))
    by = [group] if group else []
    sums = d.groupBy(*by, "_range").agg(F.sum(value).alias("_sum"))
    order = Window.partitionBy(*by) if group else Window.partitionBy()
    before = order.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*by, "_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(sums, [*by, "_range"])
    d = d.withColumn(out, (F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long"))
    return d.drop("_range", "_base")


def positions(df: DataFrame, key: str, out: str, group: str | None = None, width: int = RANGE) -> DataFrame:
    """Adds out: the number of rows of the same group with a smaller key, 0 for the first."""
    return running_total(df.withColumn("_one", F.lit(1)), key, "_one", out, group, width).drop("_one")

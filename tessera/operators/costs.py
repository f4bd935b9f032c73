"""Run logs, billing and timers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Prices of a GB-second and of an hour of each server type, in dollars.
GB_SECOND = 0.0000166667
HOURLY = {"c5.xlarge": 0.17, "c5.2xlarge": 0.34, "r5a.xlarge": 0.226, "t3.medium": 0.0416, "c5n.xlarge": 0.216, "g3s.xlarge": 0.75}


def run_facts(lines: DataFrame) -> DataFrame:
    """lines (line) of a run log -> one row: function, start, end; the last line of each kind counts by its text."""
    def take(pattern: str) -> Column:
        found = F.regexp_extract("line", pattern, 1)
        return F.max(F.when(found != "", found))

    return lines.agg(take(r"Backend\S*\s.*?:(\S+)").alias("function"), take(r"Run start time\s*:?\s*(.*)$").alias("start"), take(r"Run end time\s*:?\s*(.*)$").alias("end"))


def billed(lines: DataFrame) -> DataFrame:
    """(ms) of the lines that bill a duration."""
    ms = F.regexp_extract("line", r"Billed Duration:\s*(\d+)", 1)
    return lines.select(ms.alias("ms")).where("ms <> ''").select(F.col("ms").cast("long").alias("ms"))


def function_cost(bills: DataFrame, memory_mb: float) -> DataFrame:
    """One row: total_ms, price of a ms at that memory, cost."""
    price = GB_SECOND / (1024 / memory_mb) / 1000
    t = F.coalesce(F.sum("ms"), F.lit(0))
    return bills.agg(t.alias("total_ms"), F.lit(price).alias("price_ms"), (t * F.lit(price)).alias("cost"))


def billed_summary(bills: DataFrame, least: int = 0) -> DataFrame:
    """Count and sum in ms of the bills of at least so many ms."""
    return bills.where(F.col("ms") >= least).agg(F.count("*").alias("n"), F.coalesce(F.sum("ms"), F.lit(0)).alias("ms"))


def server_cost(fleets: DataFrame) -> DataFrame:
    """fleets (type, n, seconds) -> with hourly price and cost; unknown types have no cost."""
    prices = fleets.sparkSession.createDataFrame(list(HOURLY.items()), "type string, hourly double")
    return fleets.join(F.broadcast(prices), "type", "left").withColumn("cost", F.col("hourly") * F.col("seconds") * F.col("n") / 3600)  # as many rows as there are prices


def stage_timers(events: DataFrame) -> DataFrame:
    """events (name, ms) -> name, n, total, avg, max."""
    return events.groupBy("name").agg(F.count("*").alias("n"), F.sum("ms").alias("total"), F.avg("ms").alias("avg"), F.max("ms").alias("max"))


def output_differences(a: DataFrame, b: DataFrame, threshold: float = 1e-4) -> DataFrame:
    """a, b (pos, line) -> sections ("#" lines) with a line whose numbers add up to more in a than in b by the threshold.

    The section of a line is the last "#" line before it. Positions are ranged over in blocks first, so that no window
    holds the whole file."""
    def sums(df: DataFrame, name: str) -> DataFrame:
        total = F.aggregate(F.filter(F.split("line", r"\s+"), lambda x: x != ""), F.lit(0.0), lambda s, x: s + F.coalesce(x.try_cast("double"), F.lit(0.0)))
        return df.select("pos", total.alias(name))

    size = 1 << 16
    s = a.select("pos", F.when(F.startswith("line", F.lit("#")), F.col("line")).alias("own"), F.floor(F.col("pos") / size).alias("block"))
    heads = s.groupBy("block").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("pos"))).alias("h"))
    carry = heads.select("block", F.last("h", ignorenulls=True).over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    inside = Window.partitionBy("block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    s = s.join(carry, "block").select("pos", F.coalesce(F.last("own", ignorenulls=True).over(inside), "carry", F.lit("")).alias("section"))
    both = sums(a, "x").join(sums(b, "y"), "pos", "full_outer")
    return both.where(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)) > threshold).join(s, "pos").groupBy("section").agg(F.count("*").alias("n"))

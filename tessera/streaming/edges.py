"""Degrees kept up to date from a stream of edge files; the batch operators need none of this."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def edge_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of (src, dst) from Parquet files that arrive in a folder; self edges are left out."""
    return spark.readStream.schema("src long, dst long").option("maxFilesPerTrigger", files_per_trigger).parquet(folder).where("src <> dst")


def degree_stream(edges: DataFrame) -> DataFrame:
    """Running in-degrees: (vid, deg), in complete or update mode; the state has one counter a vertex."""
    return edges.groupBy(F.col("dst").alias("vid")).agg(F.count("*").alias("deg"))

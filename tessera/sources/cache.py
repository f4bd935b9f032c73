"""Preprocessed graphs and tensors in Parquet: written once, read whenever they are there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Reads path if a finished write left it, else makes and writes it."""
    if not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def dump_graph(tables: dict[str, DataFrame], path: str) -> None:
    """All tables of a preprocessed graph, each in a folder of its own."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}

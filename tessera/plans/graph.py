"""The graph that plans work on, and how it is derived from relational tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.arrays import as_double
from ..operators.construct import drop_self_edges


@dataclass(frozen=True)
class Graph:
    """vertices (vid, feat array<double>, label, part) and edges (src, dst): no self edges, repeated edges count."""

    vertices: DataFrame
    edges: DataFrame

    def features(self) -> DataFrame:
        return self.vertices.select("vid", "feat")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_vertices(spark: SparkSession, sf_dir: str) -> int:
    return read_table(spark, sf_dir, "embeddings").count()


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges part -> order of lineitem, folded onto the vertex ids; self edges still there."""
    n = n_vertices(spark, sf_dir)
    return read_table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % n).alias("src"), (F.col("l_orderkey") % n).alias("dst"))


def graph_from_tables(spark: SparkSession, sf_dir: str, parts: int = 4) -> Graph:
    """Embeddings are vertices with features and labels, line items are edges."""
    v = read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("vid"), as_double("embedding").alias("feat"), "label", F.pmod("vec_id", F.lit(parts)).cast("int").alias("part")
    )
    return Graph(v, drop_self_edges(raw_edges(spark, sf_dir)))


def bipartite_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part -> supplier, supplier ids behind the part ids."""
    n = read_table(spark, sf_dir, "part").count()
    return read_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + n).alias("dst"))

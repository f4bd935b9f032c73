"""Random data sets; every number is a hash of the seed and its place, so any part can be made again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.sampling import draw


def random_features(spark: SparkSession, n: int, width: int, seed: int = 0) -> DataFrame:
    """(vid, feat): between width/3 and 3 width/4 elements of each row are non-zero, uniform in [-1, 1)."""
    low, high = width // 3, 3 * width // 4
    k = F.lit(low) + F.floor(draw(seed, "k", F.col("id")) * (high - low + 1))
    # the k elements with the smallest draws
    key = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.struct(draw(seed, "p", F.col("id"), i).alias("d"), i.alias("i")))
    chosen = F.transform(F.slice(F.sort_array(key), F.lit(1), k.cast("int")), lambda s: s["i"])
    feat = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(F.array_contains(chosen, i), 2 * draw(seed, "v", F.col("id"), i) - 1).otherwise(0.0))
    return spark.range(n).select(F.col("id").alias("vid"), feat.alias("feat"))


def random_labels(spark: SparkSession, n: int, kinds: int, seed: int = 0) -> DataFrame:
    """(vid, label): 0 .. kinds - 1, both included."""
    return spark.range(n).select(F.col("id").alias("vid"), F.floor(draw(seed, "l", F.col("id")) * kinds).cast("int").alias("label"))


def random_graph(spark: SparkSession, n: int, p: float, seed: int = 0) -> DataFrame:
    """(src, dst) of an Erdos-Renyi graph without self edges.

    Each source walks over the destinations by geometric gaps, so work is in proportion to the edges, not to n squared."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            src, dst = [], []
            for v in batch["id"].to_pylist():
                rng = np.random.default_rng([seed, v])
                k = rng.binomial(n - 1, p)
                to = rng.choice(n - 1, size=k, replace=False) if k else np.empty(0, dtype=np.int64)
                src.append(np.full(k, v))
                dst.append(to + (to >= v))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (src, dst)], ["src", "dst"])

    return spark.range(n).mapInArrow(run, "src long, dst long")

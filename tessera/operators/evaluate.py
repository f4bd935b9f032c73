"""Splits, losses and accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arrays as A
from ..functions.prefix import positions

# Shares of the training and validation rows.
TRAIN, VALIDATION = 0.66, 0.1


def chunk_positions(vertices: DataFrame, chunks: int = 1) -> DataFrame:
    """(vid, part, pos, chunk, in_chunk, size): partitions are cut into chunks of ceil(n / chunks) rows by id; the last
    may be shorter."""
    sizes = vertices.groupBy("part").agg(F.count("*").alias("n"))
    p = positions(vertices.select("vid", "part"), "vid", "pos", "part").join(F.broadcast(sizes), "part")  # one row a partition
    size = F.ceil(F.col("n") / chunks)
    p = p.withColumn("chunk", F.floor(F.col("pos") / size).cast("int")).withColumn("in_chunk", F.col("pos") - F.col("chunk") * size)
    last = F.least(size, F.col("n") - F.col("chunk") * size)
    return p.select("vid", "part", "pos", "chunk", "in_chunk", last.alias("size"))


def split(chunked: DataFrame, rounding: str = "floor") -> DataFrame:
    """Adds split: the first 66 % of each chunk train, the next 10 % validate, the rest tests. rounding "ceil" is the
    converter's variant."""
    fn = F.floor if rounding == "floor" else F.ceil
    train, val = fn(F.col("size") * F.lit(TRAIN)), fn(F.col("size") * F.lit(VALIDATION))
    return chunked.withColumn("split", F.when(F.col("in_chunk") < train, "train").when(F.col("in_chunk") < train + val, "val").otherwise("test"))


def block_masks(vertices: DataFrame, blocks: int = 60) -> DataFrame:
    """(vid, split): blocks of floor(n / blocks) rows, each split by floors of all three shares; what is left over has
    no split."""
    n = vertices.count()
    size = n // blocks
    p = positions(vertices.select("vid"), "vid", "pos")
    if not size:
        return p.select("vid", F.lit(None).cast("string").alias("split"))
    train, val, test = (int(size * s) for s in (TRAIN, VALIDATION, 1 - TRAIN - VALIDATION))
    at = F.col("pos") % size
    name = F.when(F.col("pos") >= size * blocks, None).when(at < train, "train").when(at < train + val, "val").when(at < train + val + test, "test")
    return p.select("vid", name.alias("split"))


def score_rows(rows: DataFrame, p: str = "p", label: str = "label") -> DataFrame:
    """Adds hit (1 if the first largest probability is the label's) and loss (-ln of the label's probability)."""
    return rows.withColumns({"hit": (A.argmax(p) == F.col(label)).cast("int"), "loss": A.cross_entropy(p, F.col(label))})


def evaluation(scored: DataFrame, where: Column | str | None = "split = 'val'", by: list[str] | None = None) -> DataFrame:
    """n, acc and loss as means over the chosen rows; sums are partial in each task, final after the shuffle."""
    s = scored if where is None else scored.where(where)
    g = s.groupBy(*(by or []))
    return g.agg(F.count("*").alias("n"), (F.sum("hit") / F.count("*")).alias("acc"), (F.sum("loss") / F.count("*")).alias("loss"))


def masked_probabilities(p: str, one_hot: str, is_train: Column) -> Column:
    """Rows that do not train get their label for a prediction, so their gradient is zero."""
    return F.when(is_train, F.col(p)).otherwise(F.col(one_hot))


def mse(rows: DataFrame, p: str, y: str) -> DataFrame:
    """One row (loss): mean of squared differences over rows, halves as in the usual gradient p - y."""
    d = A.subtract(p, y)
    return rows.agg((F.avg(A.total(F.transform(d, lambda v: v * v))) / 2).alias("loss"))

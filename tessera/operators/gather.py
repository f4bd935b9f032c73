"""Neighbourhood aggregation: edges joined with vertex rows, grouped by the other end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import dot, scale
from .construct import in_degree, reverse

#: Widest row that is summed with one aggregate per element; wider rows are cut into blocks of at most so many.
MAX_COLUMNS = 96

AGGREGATES = {"wsum": F.sum, "add": F.sum, "mean": F.avg, "min": F.min, "max": F.max}


def width_of(x: DataFrame, column: str = "feat") -> int:
    row = x.select(F.size(column)).where(F.col(column).isNotNull()).first()
    return row[0] if row else 0


def block_size(width: int) -> int:
    """Elements a block when a row is cut into as few, about equal blocks as hold MAX_COLUMNS at most."""
    return -(-width // -(-width // MAX_COLUMNS))


def cut(rows: DataFrame, feat: str, width: int) -> DataFrame:
    """A row for each block of the arrays, numbered in the column block."""
    size = block_size(width)
    parts = F.array(*(F.slice(feat, at + 1, size) for at in range(0, width, size)))
    return rows.select(*(c for c in rows.columns if c != feat), F.posexplode(parts).alias("block", feat))


def combine(rows: DataFrame, key: str, feat: str, width: int, how: str = "wsum", name: str = "feat") -> DataFrame:
    """rows (key, feat array) -> (key, name): element-wise aggregate of the arrays of each key.

    Up to MAX_COLUMNS elements one hash aggregate holds a sum per element, with partial sums before the shuffle, so a
    hub's rows never meet whole; beyond, see combine_blocks()."""
    fn = AGGREGATES[how]
    if width <= MAX_COLUMNS:
        flat = rows.select(key, *(F.get(feat, F.lit(i)).alias(f"c{i}") for i in range(width)))
        sums = flat.groupBy(key).agg(*(fn(f"c{i}").alias(f"c{i}") for i in range(width)))
        return sums.select(key, F.array(*(f"c{i}" for i in range(width))).alias(name))
    return combine_blocks(cut(rows.select(key, feat), feat, width), key, feat, width, how, name)


def combine_blocks(blocks: DataFrame, key: str, feat: str, width: int, how: str = "wsum", name: str = "feat", weight: str | None = None) -> DataFrame:
    """combine() of rows that are cut already, each times its weight.

    What the tasks before the shuffle write is a partial sum of nearly every key for every task, so there are no more
    of them than two a core; a finished row is put together from its blocks."""
    fn, size = AGGREGATES[how], block_size(width)
    few = blocks.coalesce(2 * blocks.sparkSession.sparkContext.defaultParallelism)
    one = lambda i: F.get(feat, F.lit(i)) * F.col(weight) if weight else F.get(feat, F.lit(i))
    flat = few.select(key, "block", *(one(i).alias(f"c{i}") for i in range(size)))
    sums = flat.groupBy(key, "block").agg(*(fn(f"c{i}").alias(f"c{i}") for i in range(size)))
    whole = sums.select(key, F.struct("block", F.array(*(f"c{i}" for i in range(size))).alias("v")).alias("b")).groupBy(key).agg(F.sort_array(F.collect_list("b")).alias("b"))
    return whole.select(key, F.slice(F.flatten("b.v"), 1, width).alias(name))


def edge_rows(edges: DataFrame, x: DataFrame, end: str = "src", name: str = "feat") -> DataFrame:
    """The edges with the row of one end: the edge view of a vertex tensor."""
    return edges.join(x.select(F.col("vid").alias(end), F.col("feat").alias(name)), end)


def gather(edges: DataFrame, x: DataFrame, self_weights: DataFrame | None = None, weight: str | Column | None = "w", how: str = "wsum",
           backward: bool = False, width: int | None = None) -> DataFrame:
    """out[v] = self_w[v] x[v] + sum over incoming edges of w x[src], for every vertex of x; backward: over outgoing
    edges. (vid, feat) -> (vid, feat).

    Without self_weights a vertex without edges is left out. Self rows join the same aggregate by a union, so there is
    one shuffle for the sums; AQE splits hub sources in the join and partial sums take care of hub destinations."""
    e = reverse(edges) if backward else edges
    width = width or width_of(x)
    if width > MAX_COLUMNS:
        return _gather_wide(e, x, self_weights, weight, how, width)
    rows = edge_rows(e, x)
    if weight is not None:
        w = F.col(weight) if isinstance(weight, str) else weight
        rows = rows.select(F.col("dst").alias("vid"), scale(F.col("feat"), w).alias("feat"))
    else:
        rows = rows.select(F.col("dst").alias("vid"), "feat")
    if self_weights is not None:
        own = x.join(self_weights, "vid").select("vid", scale(F.col("feat"), F.col("w")).alias("feat"))
        rows = rows.unionByName(own)
    return combine(rows, "vid", "feat", width, how)


def _gather_wide(e: DataFrame, x: DataFrame, self_weights: DataFrame | None, weight: str | Column | None, how: str, width: int) -> DataFrame:
    """gather() over edges in their direction; vertex rows are cut before the join, the weights go into the aggregate."""
    blocks = cut(x.select("vid", "feat"), "feat", width)
    w = F.lit(1.0) if weight is None else F.col(weight) if isinstance(weight, str) else weight
    e = e.select("src", "dst", w.alias("w"))
    rows = e.join(blocks.withColumnRenamed("vid", "src"), "src").select(F.col("dst").alias("vid"), "block", "feat", "w")
    if self_weights is not None:
        rows = rows.unionByName(blocks.join(self_weights, "vid").select("vid", "block", "feat", "w"))
    return combine_blocks(rows, "vid", "feat", width, how, weight="w")


def neighbour_sum(edges: DataFrame, x: DataFrame, width: int, backward: bool = False, name: str = "feat") -> DataFrame:
    """(vid, name): plain sum of the rows at the other ends of a vertex's edges, a row of zeros where it has none. Edges
    carry no weight, so their rows go into the aggregate as they are."""
    e = reverse(edges.select("src", "dst")) if backward else edges.select("src", "dst")
    rows = edge_rows(e, x).select(F.col("dst").alias("vid"), "feat")
    none = x.select("vid", F.array(*(F.lit(0.0) for _ in range(width))).alias("feat"))
    return combine(rows.unionByName(none), "vid", "feat", width, name=name)


def attention_gather(scored: DataFrame, z: DataFrame, width: int | None = None) -> DataFrame:
    """ah[v] = z[v] + sum over incoming edges of a z[src]; scored (src, dst, a)."""
    width = width or width_of(z)
    rows = edge_rows(scored, z).select(F.col("dst").alias("vid"), scale(F.col("feat"), F.col("a")).alias("feat"))
    return combine(rows.unionByName(z.select("vid", "feat")), "vid", "feat", width)


def attention_gather_backward(scored: DataFrame, grad: DataFrame, d_scores: DataFrame, z: DataFrame, width: int | None = None) -> DataFrame:
    """g[v] = grad[v] + sum over outgoing edges of a grad[dst] + sum over incoming edges of da z[src].

    scored (src, dst, a) are forward's attention values, used as the transpose; d_scores (src, dst, da)."""
    width = width or width_of(grad)
    out = edge_rows(scored, grad, "dst").select(F.col("src").alias("vid"), scale(F.col("feat"), F.col("a")).alias("feat"))
    into = edge_rows(d_scores, z).select(F.col("dst").alias("vid"), scale(F.col("feat"), F.col("da")).alias("feat"))
    rows = grad.select("vid", "feat").unionByName(out).unionByName(into)
    return combine(rows, "vid", "feat", width)


def expand_dot(edges: DataFrame, x: DataFrame, vector: list[float], end: str = "dst", name: str = "score") -> DataFrame:
    """Edges with dot(x[end], vector): taken once a vertex, then joined."""
    v = F.array(*(F.lit(float(a)) for a in vector))
    per = x.select(F.col("vid").alias(end), dot(F.col("feat"), v).alias(name))
    return edges.join(per, end)


def expand_hadamard(edges: DataFrame, x: DataFrame, scalar: str, end: str = "dst", name: str = "row") -> DataFrame:
    """Edges with x[end] times the edge's scalar."""
    e = edge_rows(edges, x, end, "_x")
    return e.withColumn(name, scale(F.col("_x"), F.col(scalar))).drop("_x")


def outer_product_sum(edges: DataFrame, x: DataFrame) -> DataFrame:
    """(i, j, val): sum over edges of x[src] outer x[dst].

    Rearranged: sources are summed into each destination first, so the product is taken once a vertex, not an edge."""
    into = gather(edges.select("src", "dst"), x, None, None)
    both = into.join(x.select("vid", F.col("feat").alias("own")), "vid")
    a = both.select(F.posexplode("feat").alias("i", "a"), "own")
    return a.select("i", "a", F.posexplode("own").alias("j", "b")).groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("val"))


def column_sum(rows: DataFrame, feat: str = "feat") -> DataFrame:
    """(i, val): sums over all rows, element by element."""
    return rows.select(F.posexplode(feat).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("val"))


def graph_convolution(vertices: DataFrame, edges: DataFrame, x: DataFrame, norm: str = "both", width: int | None = None) -> DataFrame:
    """Sum of source rows scaled by degrees of at least 1: none, right (mean) or both sides. Every vertex has a row."""
    width = width or width_of(x)
    left = x
    one = lambda d: F.greatest(F.col(d), F.lit(1)).cast("double")
    if norm == "both":
        out = in_degree(vertices, reverse(edges.select("src", "dst")), "od")
        left = x.join(out, "vid").select("vid", scale(F.col("feat"), 1 / F.sqrt(one("od"))).alias("feat"))
    got = gather(edges.select("src", "dst"), left, None, None, width=width)
    zero = F.array(*(F.lit(0.0) for _ in range(width)))
    got = vertices.select("vid").join(got, "vid", "left").select("vid", F.coalesce("feat", zero).alias("feat"))
    if norm == "none":
        return got
    into = in_degree(vertices, edges, "id")
    k = 1 / F.sqrt(one("id")) if norm == "both" else 1 / one("id")
    return got.join(into, "vid").select("vid", scale(F.col("feat"), k).alias("feat"))

"""Steps of the two models on rows of vertices: the products run in blocks, everything between them in expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions import arrays as A
from .dense import map_rows
from .gather import attention_gather, attention_gather_backward, expand_dot, gather

SHARE = 0.66


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / (e.sum(axis=1, keepdims=True) + A.SOFTMAX_FLOOR)


def _mix(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit integers, mixed (a shift and multiply finalizer)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def hashed(vid: np.ndarray, key: np.ndarray, t: int) -> np.ndarray:
    """A number in [0, 1) for each pair of vid and key, by a hash of both and t."""
    far = np.uint64(0x9E3779B97F4A7C15)
    salt = _mix(key.astype(np.int64).astype(np.uint64) + far) + _mix(np.array([t + 1], np.uint64) * far)
    return (_mix(_mix(vid.astype(np.int64).astype(np.uint64) + salt)) >> np.uint64(11)) / float(1 << 53)


def dropout_mask(vid: np.ndarray, width: int, share: float, *key: int) -> np.ndarray:
    """1 / (1 - share) where a unit is kept, else 0; a hash of vertex, unit and key, so a lost task draws it again."""
    salt = np.uint64(0)
    for k in key:
        salt = _mix(np.array([k], np.int64).astype(np.uint64) + salt + np.uint64(0x9E3779B97F4A7C15))[0]
    units = _mix(np.arange(1, width + 1, dtype=np.uint64) ^ salt)
    drawn = _mix(_mix(vid.astype(np.int64).astype(np.uint64) + salt)[:, None] + units[None, :])
    return ((drawn >> np.uint64(11)) / float(1 << 53) >= share) / (1 - share)


def gcn_hidden(ah: DataFrame, w: np.ndarray) -> DataFrame:
    """z = ah W, h = tanh z: (vid, feat) -> (vid, z, h)."""

    def step(a):
        z = a @ w
        return {"z": z, "h": np.tanh(z)}

    return map_rows(ah, step, ["feat"], ["z", "h"], ["vid"])


def gcn_output(ah: DataFrame, labels: DataFrame, w: np.ndarray, n_total: int, multiplied: bool = False) -> DataFrame:
    """The last layer with its backward step: (vid, feat) and (vid, label, split) -> vid, label, split, ah, p, d, grad.

    p = softmax(ah W); d = (p - y) / (0.66 n_total) on training rows, else 0; grad = d W'. The gradient of W is
    gram(ah, d). multiplied: the rows went through W before they were gathered."""
    rows = ah.join(labels, "vid").withColumn("train", (F.col("split") == "train").cast("double"))

    def step(a, label, train):
        p = _softmax(a if multiplied else a @ w)
        d = p.copy()
        d[np.arange(len(d)), label.astype(np.int64)] -= 1
        d *= (train / (n_total * SHARE))[:, None]
        return {"p": p, "d": d, "grad": d @ w.T}

    rows = rows.withColumnRenamed("feat", "ah")
    return map_rows(rows, step, ["ah", "label", "train"], ["p", "d", "grad"], ["vid", "label", "split", "ah"])


def gcn_hidden_backward(rows: DataFrame, w: np.ndarray | None) -> DataFrame:
    """(vid, atg, z, ..) -> g = atg * (1 - tanh(z)^2) and, given W, grad = g W'. The gradient of W is gram(ah, g)."""
    keep = [c for c in rows.columns if c not in ("atg", "z")]

    def step(atg, z):
        g = atg * (1 - np.tanh(z) ** 2)
        return {"g": g} | ({"grad": g @ w.T} if w is not None else {})

    return map_rows(rows, step, ["atg", "z"], ["g"] + ["grad"] * (w is not None), keep)


def gat_scores(edges: DataFrame, z: DataFrame, a: np.ndarray, slope: float = A.LEAKY_SLOPE) -> DataFrame:
    """(src, dst, az, a): az = z[dst] . a, a its leaky ReLU. The score depends on the destination alone."""
    scored = expand_dot(edges.select("src", "dst"), z, list(a), "dst", "az")
    return scored.withColumn("a", A.leaky(F.col("az"), slope))


def _scores(z: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score of every row as a column, and its slope."""
    az = z @ a
    return np.where(az > 0, az, az * A.LEAKY_SLOPE)[:, None], np.where(az > 0, 1.0, A.LEAKY_SLOPE)[:, None]


def gat_rows(z: np.ndarray, s: np.ndarray, a: np.ndarray) -> np.ndarray:
    """ah = z + a s, where s is the sum of the sources' rows: a destination's score leaves the sum over its edges."""
    return z + _scores(z, a)[0] * s


def gat_push(z: np.ndarray, grad: np.ndarray, a: np.ndarray) -> np.ndarray:
    """What a destination gives back to each of its sources."""
    return _scores(z, a)[0] * grad


def gat_rows_backward(z: np.ndarray, s: np.ndarray, grad: np.ndarray, u: np.ndarray, a: np.ndarray) -> np.ndarray:
    """grad + u + da s: u the sum of what the destinations push back, da the gradient of the row's own score."""
    return grad + u + _scores(z, a)[1] * (grad @ a)[:, None] * s


def gat_slopes(z: np.ndarray, grad: np.ndarray, degree: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Slope times in-degree times grad; with z'z its column sums give the gradient of the attention vector."""
    return _scores(z, a)[1] * degree[:, None] * grad


def neighbour_softmax(scored: DataFrame) -> DataFrame:
    """Optional: a normalized over the incoming edges of each destination, two grouped values joined back."""
    top = scored.groupBy("dst").agg(F.max("a").alias("_top"))
    e = scored.join(top, "dst").withColumn("_e", F.exp(F.col("a") - F.col("_top")))
    total = e.groupBy("dst").agg(F.sum("_e").alias("_sum"))
    return e.join(total, "dst").withColumn("a", F.col("_e") / (F.col("_sum") + F.lit(A.SOFTMAX_FLOOR))).drop("_top", "_e", "_sum")


def gat_forward(edges: DataFrame, z: DataFrame, a: np.ndarray, width: int, softmax: bool = False) -> tuple[DataFrame, DataFrame]:
    """(scored edges, ah) of one layer from z = h W."""
    scored = gat_scores(edges, z, a)
    if softmax:
        scored = neighbour_softmax(scored)
    return scored, attention_gather(scored, z, width)


def gat_predict(ah: DataFrame, labels: DataFrame, kinds: int) -> DataFrame:
    """softmax(ah) - one hot, for all rows: (vid, label, p, feat)."""
    return ah.join(labels, "vid").withColumn("p", A.softmax("feat")).select("vid", "label", "p", A.subtract(F.col("p"), A.one_hot(F.col("label"), kinds)).alias("feat"))


def gat_edge_backward(scored: DataFrame, grad: DataFrame, a: np.ndarray) -> DataFrame:
    """(src, dst, da): da = leaky'(az) grad[dst] . a; grad meets a once a vertex, before the edges."""
    e = expand_dot(scored.select("src", "dst", "az"), grad, list(a), "dst", "ga")
    return e.select("src", "dst", (A.leaky_gradient(F.col("az")) * F.col("ga")).alias("da"))


def gat_attention_gradient(scored: DataFrame, grad: DataFrame, z: DataFrame, width: int) -> np.ndarray:
    """da = (z' z) (sum over edges of leaky'(az) grad[dst])'. The edges are summed to a scalar a vertex first."""
    from .dense import collect_matrix, gram

    k = scored.groupBy(F.col("dst").alias("vid")).agg(F.sum(A.leaky_gradient(F.col("az"))).alias("k"))
    rows = grad.join(k, "vid").select(*(F.sum(F.get("feat", F.lit(i)) * F.col("k")).alias(f"c{i}") for i in range(width))).first()
    total = np.array([rows[i] or 0.0 for i in range(width)])
    zz = collect_matrix(gram(z.withColumn("z2", F.col("feat")), "feat", "z2"), (width, width))
    return zz @ total


def gat_backward(scored: DataFrame, d_scores: DataFrame, grad: DataFrame, z: DataFrame, width: int) -> DataFrame:
    return attention_gather_backward(scored.select("src", "dst", "a"), grad, d_scores, z, width)


__all__ = [n for n in dir() if n.startswith(("gcn", "gat", "neighbour"))] + ["gather"]

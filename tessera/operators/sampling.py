"""Neighbour sampling and the models that the comparison scripts train on samples; seeded by hashes, never by state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import arrays as A
from .gather import gather
from .layers import hashed

#: Incoming edges of a vertex are dealt by their sources into so many lists, and those cut after so many entries, so that a
#: hub's edges fit into tasks and rows.
SALTS, ENTRIES = 8, 1 << 16


def draw(*parts) -> Column:
    """A number in [0, 1) from a hash of the parts, the same in any engine: 13 hex digits of an MD5."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(16**13)


def sample_neighbours(edges: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """At most k incoming edges of each vertex without replacement; repeated edges are drawn one by one.

    Ranking uses a top-k window: Spark cuts each task's rows to k a vertex before the shuffle."""
    twin = Window.partitionBy("src", "dst").orderBy("src")
    e = edges.select("src", "dst").withColumn("nth", F.row_number().over(twin))
    order = Window.partitionBy("dst").orderBy(draw(seed, F.col("src"), F.col("dst"), F.col("nth")), "src", "nth")
    return e.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("src", "dst", "rank")


def sample_with_replacement(edges: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Exactly k draws for each vertex with incoming edges: draw t picks the edge of a hashed position. (src, dst, t)."""
    e = edges.select("src", "dst").withColumn("pos", F.row_number().over(Window.partitionBy("dst").orderBy("src")) - 1)
    n = edges.groupBy("dst").agg(F.count("*").alias("n"))
    picks = n.select("dst", "n", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("t"))
    picks = picks.select("dst", "t", F.floor(draw(seed, F.col("dst"), F.col("t")) * F.col("n")).cast("int").alias("pos"))
    return picks.join(e, ["dst", "pos"]).select("src", "dst", "t")


def block(edges: DataFrame, want: DataFrame, k: int, seed: int = 0, replace: bool = False) -> DataFrame:
    """(src, dst): k drawn edges into each wanted vertex (vid)."""
    into = edges.join(want.select(F.col("vid").alias("dst")), "dst", "left_semi")
    return (sample_with_replacement if replace else sample_neighbours)(into, k, seed).select("src", "dst")


def blocks(edges: DataFrame, seeds: DataFrame, fanouts: list[int], seed: int = 0, replace: bool = False) -> list[DataFrame]:
    """Edges of each hop, outermost first, that the seeds (vid) need."""
    out, want = [], seeds.select("vid").distinct()
    for hop, k in enumerate(reversed(fanouts)):
        got = block(edges, want, k, seed + hop, replace)
        out.insert(0, got)
        want = want.unionByName(got.select(F.col("src").alias("vid"))).distinct()
    return out


def in_lists(edges: DataFrame) -> DataFrame:
    """(dst, salt, chunk, srcs): the sources of each vertex's incoming edges in lists, in which an edge has a fixed place."""
    e = edges.where("src IS NOT NULL AND dst IS NOT NULL").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    e = e.withColumn("salt", F.pmod(F.hash("src"), F.lit(SALTS))).repartition("dst", "salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b[c].to_numpy() for c in ("src", "dst", "salt")] for b in batches if b.num_rows]
        if not got:
            return
        src, dst, salt = (np.concatenate(x) for x in zip(*got))
        del got
        order = np.lexsort((src, salt, dst))
        src, dst, salt = src[order], dst[order], salt[order]
        new = np.r_[True, (dst[1:] != dst[:-1]) | (salt[1:] != salt[:-1])]
        place = np.arange(len(src)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        at = np.flatnonzero(place % ENTRIES == 0)
        ends = np.r_[at, len(src)]
        for lo in range(0, len(at), 4096):
            a, e = at[lo : lo + 4096], ends[lo : lo + 4097]
            srcs = pa.ListArray.from_arrays(pa.array((e - e[0]).astype(np.int32)), pa.array(src[e[0] : e[-1]]))
            yield pa.RecordBatch.from_arrays([pa.array(dst[a]), pa.array(salt[a].astype(np.int32)), pa.array((place[a] // ENTRIES).astype(np.int32)), srcs], ["dst", "salt", "chunk", "srcs"])

    return e.mapInArrow(run, "dst long, salt int, chunk int, srcs array<long>")


def list_sizes(lists: DataFrame) -> DataFrame:
    """(dst, sizes): how many incoming edges a vertex has under each salt."""
    n = F.size("srcs").cast("long")
    return lists.groupBy("dst").agg(F.array(*(F.sum(F.when(F.col("salt") == i, n).otherwise(0)) for i in range(SALTS))).alias("sizes"))


def drawn_places(n: np.ndarray, vid: np.ndarray, key: np.ndarray, k: int, replace: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(places, valid), a row for each vertex: k places below n, any set of places as likely as any other (Floyd's rule); all
    places if there are no more than k. With replacement k places wherever n > 0."""
    count = np.where(n > 0, k, 0) if replace else np.minimum(n, k)
    places = np.full((len(n), k), -1, dtype=np.int64)
    for i in range(k):
        top = n if replace else n - count + i + 1
        x = np.minimum((hashed(vid, key, i) * top).astype(np.int64), top - 1)
        if not replace:
            x = np.where((places[:, :i] == x[:, None]).any(axis=1), top - 1, x)
        places[:, i] = np.where(i < count, x, -1)
    return places, places >= 0


def drawn_rows(lists: DataFrame, sizes: DataFrame, want: DataFrame, k: int, replace: bool = False) -> DataFrame:
    """want (step, key, vid) -> (step, src, dst, w): for all steps at once, k drawn edges into each wanted vertex and a loop,
    w one over their number. What is drawn hangs on key and vertex alone; the cost of a draw does not hang on degrees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            step, key, vid = (b[c].to_numpy() for c in ("step", "key", "vid"))
            size = np.array(b["sizes"].flatten()).reshape(-1, SALTS)
            ends = np.cumsum(size, axis=1)
            places, valid = drawn_places(ends[:, -1], vid, key, k, replace)
            row, col = np.nonzero(valid)
            x = places[row, col]
            salt = (x[:, None] >= ends[row]).sum(axis=1)
            x = x - (ends[row, salt] - size[row, salt])
            w = 1 / (valid.sum(axis=1) + 1)
            own = np.arange(len(vid))
            row, none = np.r_[row, own], np.full(len(vid), -1)
            columns = [step[row], vid[row], w[row], np.r_[salt, none].astype(np.int32), np.r_[x // ENTRIES, none].astype(np.int32), np.r_[x % ENTRIES, none].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["step", "dst", "w", "salt", "chunk", "at"])

    none = F.array(*(F.lit(0).cast("long") for _ in range(SALTS)))
    known = want.join(sizes.withColumnRenamed("dst", "vid"), "vid", "left").select("step", "key", "vid", F.coalesce("sizes", none).alias("sizes"))
    places = known.mapInArrow(run, "step int, dst long, w double, salt int, chunk int, at int")
    # a loop has no list, so it keeps its own end
    return places.join(lists, ["dst", "salt", "chunk"], "left").select("step", F.coalesce(F.get("srcs", F.col("at")), "dst").alias("src"), "dst", "w")


def ego_hops(edges: DataFrame, seeds: DataFrame, hops: int, k: int | None = None) -> DataFrame:
    """(root, vid, hop): what lies within so many hops upstream of each seed; with k the k smallest ids of each vertex."""
    e = edges.select("src", "dst").distinct()
    if k is not None:
        order = Window.partitionBy("dst").orderBy("src")
        e = e.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")
    level = seeds.select(F.col("vid").alias("root"), "vid", F.lit(0).alias("hop"))
    out = level
    for hop in range(1, hops + 1):
        level = level.join(e.withColumnRenamed("dst", "vid"), "vid").select("root", F.col("src").alias("vid"), F.lit(hop).alias("hop")).distinct()
        out = out.unionByName(level)
    return out.groupBy("root", "vid").agg(F.min("hop").alias("hop"))


def sage_layer(edges: DataFrame, x: DataFrame, width: int) -> DataFrame:
    """The "gcn" aggregator: mean over the incoming rows and the vertex's own."""
    rows = edges.select("src", "dst").unionByName(x.select(F.col("vid").alias("src"), F.col("vid").alias("dst")))
    return gather(rows, x, None, None, "mean", width=width)


def dropout(feat: Column, rate: float, *key) -> Column:
    """Zeroes each element with the probability rate and scales up the rest, by a hash of key and position."""
    keep = 1 - rate
    return F.transform(feat, lambda v, i: F.when(draw(*key, i) < keep, v / keep).otherwise(0.0))


def negative_edges(edges: DataFrame, n_vertices: int, k: int = 1, seed: int = 0) -> DataFrame:
    """(src, dst, t): k hashed destinations for each distinct edge's source, none of which is an edge."""
    e = edges.select("src", "dst").distinct()
    t = e.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    n = t.select("src", F.floor(draw(seed, F.col("src"), F.col("dst"), F.col("t")) * n_vertices).cast("long").alias("dst"), "t")
    return n.where("src <> dst").join(e, ["src", "dst"], "left_anti")


def without_seed_edges(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges other than the seed edges and their reverses."""
    s = seeds.select("src", "dst").unionByName(seeds.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.join(s.distinct(), ["src", "dst"], "left_anti")


def edge_scores(edges: DataFrame, x: DataFrame) -> DataFrame:
    """Edges with score = x[src] . x[dst]."""
    a = x.select(F.col("vid").alias("src"), F.col("feat").alias("_a"))
    b = x.select(F.col("vid").alias("dst"), F.col("feat").alias("_b"))
    return edges.join(a, "src").join(b, "dst").withColumn("score", A.dot("_a", "_b")).drop("_a", "_b")


def logit_loss(score: Column, positive: Column) -> Column:
    """Binary cross-entropy of a logit, in the form that does not overflow."""
    y = F.when(positive, 1.0).otherwise(0.0)
    return F.greatest(score, F.lit(0.0)) - score * y + F.log1p(F.exp(-F.abs(score)))


def batches(ids: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """(vid, batch): rows in hashed order, size to a batch (about: batches are equal ranges of the hash)."""
    n = ids.count()
    return ids.select("vid", F.floor(draw(seed, F.col("vid")) * max(1, -(-n // size))).cast("int").alias("batch"))


def standardized(x: DataFrame, width: int) -> DataFrame:
    """Every element less its mean over its population deviation (0: left at 0)."""
    stats = x.agg(*(f(F.get("feat", F.lit(i))).alias(f"{n}{i}") for i in range(width) for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    row = F.broadcast(stats)  # one row
    value = [F.when(F.col(f"s{i}") > 0, (F.get("feat", F.lit(i)) - F.col(f"m{i}")) / F.col(f"s{i}")).otherwise(0.0) for i in range(width)]
    return x.join(row).select("vid", F.array(*value).alias("feat"))


def linear_probe(x: DataFrame, labels: DataFrame, train: DataFrame, width: int, max_iter: int = 50) -> DataFrame:
    """(vid, label, prediction): multinomial logistic regression on standardized rows, fitted on the train ids."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = standardized(x, width).join(labels, "vid").select("vid", array_to_vector("feat").alias("features"), F.col("label").cast("double").alias("label"))
    model = LogisticRegression(family="multinomial", maxIter=max_iter).fit(rows.join(train.select("vid"), "vid", "left_semi"))
    return model.transform(rows).select("vid", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"))

"""Distributed connected components by repeated contraction; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, durable


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64) -> DataFrame:
    """edges (a, b) of any one orderable type -> one row (id, component) per endpoint, component = smallest id reachable.

    Each round every node points to its smallest neighbour if that is smaller than itself, pointers are doubled until
    they rest at a root, and the edges are rewritten to the roots of their ends. A node always points into its own
    component and the smallest node of a component points to itself, so the images keep the components and the last
    survivor is the smallest id. A path of n nodes needs log2(n) doublings. Groups are only reduced by min(), never
    collected; a hub costs one skewed equi-join that AQE splits.
    Null ends and self-edges carry no link and are dropped; repeated edges count once; no edges give an empty result."""
    live = durable(
        edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a") != F.col("b")).distinct(), "cc-edges"
    )
    if live.isEmpty():
        return live.select(F.col("a").alias("id"), F.col("b").alias("component"))
    maps: list[DataFrame] = []
    for _ in range(max_rounds):
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = durable(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p")), "cc-least")
        step = least
        while True:
            up = step.select(F.col("a").alias("p"), F.col("p").alias("q"))
            hop = step.select("a", "p").join(up, "p", "left").select("a", F.coalesce("q", "p").alias("p"), (F.col("q") < F.col("p")).alias("moved"))
            hop = durable(hop, "cc-step")
            discard(step)
            step = hop
            if step.where("moved").isEmpty():
                break
        maps.append(step)
        old = live
        left = step.select("a", F.col("p").alias("x"))
        right = step.select(F.col("a").alias("b"), F.col("p").alias("y"))
        live = durable(
            live.join(left, "a").join(right, "b").where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "cc-edges",
        )
        discard(old)
        if live.isEmpty():
            break
    else:
        raise RuntimeError("connected components did not settle")
    out = maps[0].select(F.col("a").alias("id"), F.col("p").alias("component"))
    for step in maps[1:]:
        hop = step.select(F.col("a").alias("component"), F.col("p").alias("next"))
        out = out.join(hop, "component", "left").select("id", F.coalesce("next", "component").alias("component"))
    out = durable(out, "cc-labels")
    discard(live, *maps)
    return out

"""Approximate nearest neighbours over learned partitions of a neighbour graph."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import durable


@dataclass(frozen=True)
class RouterParams:
    """sample bounds the vectors that the graph and the classifier are made from, and so the driver's memory; every row
    is indexed. There is a part for every part_rows rows, at least `parts`, as long as the sample has 64 rows for each.
    chunk bounds the rows of either side that one task compares at once."""

    sample: int = 8_192
    parts: int = 16
    part_rows: int = 4_096
    graph_k: int = 10
    slack: float = 1.05
    rounds: int = 8
    hidden: int = 64
    steps: int = 200
    rate: float = 0.02
    recall: float = 0.96
    chunk: int = 20_000
    seed: int = 7


@dataclass
class Router:
    """A small network that tells how probable each partition is for a direction, and how many to probe."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    @property
    def parts(self) -> int:
        return len(self.b2)

    def logits(self, unit: np.ndarray) -> np.ndarray:
        return np.maximum(unit @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def route(self, unit: np.ndarray, m: int) -> np.ndarray:
        """The m most probable partitions of each row; ties to the smaller number."""
        return np.argsort(-self.logits(unit), axis=1, kind="stable")[:, :m]


def usable(embedding: str = "embedding"):
    """Whether a vector is there, holds only finite numbers and is not zero."""
    e = F.transform(embedding, lambda x: x.cast("double"))
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.col(embedding).isNotNull() & fine & F.exists(e, lambda x: x != 0), F.lit(False))


def unit_rows(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)  # keeps squares in range
    x = x / top
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def in_range(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that squares neither overflow nor vanish; cosines stay the same to the last bit."""
    if not x.size:
        return x
    _, e = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, -e[:, None])


def neighbour_graph(unit: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest other rows of each row."""
    n = len(unit)
    k = min(k, n - 1)
    out = np.empty((n, k), dtype=np.int64)
    for at in range(0, n, 1024):
        s = unit[at : at + 1024] @ unit.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
        out[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(graph: np.ndarray, parts: int, slack: float, rounds: int, seed: int) -> np.ndarray:
    """Labels of a partition of the graph that cuts few edges; no part exceeds slack times its share.

    Starts from random balanced labels grown breadth first, then moves vertices to the part where most of their
    neighbours are, best gain first, while the part has room."""
    n = len(graph)
    rng = np.random.default_rng(seed)
    room = int(np.ceil(n / parts * slack))
    back = [[] for _ in range(n)]
    for i, row in enumerate(graph.tolist()):
        for j in row:
            back[j].append(i)
    near = [graph[i].tolist() + back[i] for i in range(n)]
    label = np.full(n, -1)
    order = rng.permutation(n).tolist()
    at = 0
    for p in range(parts):
        want, queue = n // parts + (p < n % parts), []
        while want:
            if queue:
                v = queue.pop(0)
            else:
                while label[order[at]] >= 0:
                    at += 1
                v = order[at]
            if label[v] >= 0:
                continue
            label[v] = p
            want -= 1
            queue += [u for u in near[v] if label[u] < 0]
    size = np.bincount(label, minlength=parts)
    for _ in range(rounds):
        votes = np.zeros((n, parts), dtype=np.int32)
        for v in range(n):
            votes[v] = np.bincount(label[near[v]], minlength=parts)
        best = votes.argmax(axis=1)
        gain = votes.max(axis=1) - votes[np.arange(n), label]
        moved = 0
        for v in np.argsort(-gain, kind="stable").tolist():
            if gain[v] <= 0:
                break
            if size[best[v]] < room:
                size[label[v]] -= 1
                size[best[v]] += 1
                label[v] = best[v]
                moved += 1
        if not moved:
            break
    return label


def fit_router(unit: np.ndarray, p: RouterParams = RouterParams(), rows: int = 0) -> Router:
    """Graph, balanced partition and classifier of unit rows, a sample of `rows` rows; the classifier learns how a row's
    neighbours spread over the parts. The number of probes is the least that reaches p.recall among the rows' own nearest five."""
    n, d = unit.shape if unit.size else (0, 1)
    parts = max(1, min(max(p.parts, rows // p.part_rows), n // 64))
    rng = np.random.default_rng(p.seed)
    if parts == 1:
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    graph = neighbour_graph(unit, p.graph_k)
    label = balanced_partition(graph, parts, p.slack, p.rounds, p.seed)
    target = np.zeros((n, parts))
    np.add.at(target, (np.repeat(np.arange(n), graph.shape[1]), label[graph].ravel()), 1)
    target[np.arange(n), label] += 1
    target /= target.sum(axis=1, keepdims=True)
    w = [rng.normal(size=(d, p.hidden)) * np.sqrt(2 / d), np.zeros(p.hidden), rng.normal(size=(p.hidden, parts)) * np.sqrt(1 / p.hidden), np.zeros(parts)]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for t in range(1, p.steps + 1):
        rows = rng.integers(0, n, 1024)
        x, y = unit[rows], target[rows]
        h = np.maximum(x @ w[0] + w[1], 0)
        z = h @ w[2] + w[3]
        q = np.exp(z - z.max(axis=1, keepdims=True))
        e = (q / q.sum(axis=1, keepdims=True) - y) / len(rows)
        g2 = h.T @ e
        eh = (e @ w[2].T) * (h > 0)
        for i, g in enumerate((x.T @ eh, eh.sum(axis=0), g2, e.sum(axis=0))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            w[i] = w[i] - p.rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    router = Router(*w, parts)
    order = router.route(unit, parts)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :].repeat(n, axis=0), axis=1)
    five = neighbour_graph(unit, 5)
    at = np.take_along_axis(rank, order[:, 0][five], axis=1)
    router.probes = int(next(k for k in range(1, parts + 1) if (at < k).mean() >= p.recall))
    return router


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def _assign(router, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = router.value
        for batch in batches:
            if not batch.num_rows:
                continue
            to = r.route(unit_rows(_matrix(batch["embedding"])), m or r.probes)
            at = np.repeat(np.arange(len(to)), to.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"].take(pa.array(at)), batch["embedding"].take(pa.array(at)), pa.array(to.ravel().astype(np.int32))], ["vec_id", "embedding", "part"]
            )

    return run


def best_of(queries: np.ndarray, ids: np.ndarray, base: np.ndarray, base_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, vec_id, cosine) of the k nearest rows with another id for each query, ties to smaller ids.

    A matrix product finds who can be among the nearest; their cosines are then taken row by row in one order of
    summation, so that equal vectors get equal scores wherever they are compared."""
    found = [[], [], []]
    queries, base = in_range(queries), in_range(base)
    nb = np.sqrt((base * base).sum(axis=1))
    nq = np.sqrt((queries * queries).sum(axis=1))
    for at in range(0, len(queries), 256):
        s = (queries[at : at + 256] / nq[at : at + 256, None]) @ (base / nb[:, None]).T
        s[ids[at : at + 256, None] == base_ids[None, :]] = -3
        for i in range(len(s)):
            row = s[i]
            if len(row) > k:
                row = np.flatnonzero(row >= np.partition(row, -k)[-k] - 1e-9)
            else:
                row = np.arange(len(row))
            row = row[s[i][row] > -2]
            q = queries[at + i]
            score = (base[row] * q).sum(axis=1) / (nb[row] * nq[at + i])
            top = np.lexsort((base_ids[row], -score))[:k]
            found[0].append(np.full(len(top), at + i))
            found[1].append(base_ids[row][top])
            found[2].append(score[top])
    if not found[0]:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
    return tuple(np.concatenate(x) for x in found)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, params: RouterParams = RouterParams()) -> DataFrame:
    """vectors and queries (vec_id, embedding) -> query_id, rank, vec_id, score: each query's k nearest by cosine in
    double precision among the vectors with another id in the partitions it is routed to.

    Vectors that are null, zero or hold nulls or non-finite numbers take no part, nor do null ids and vectors whose
    length is not the commonest. Repeated rows of vectors are candidates of their own; repeated queries are asked once, and
    queries of one id with different vectors each get their own ranks. Fewer candidates than k give fewer rows.
    Partitions are compared in blocks of at most params.chunk vectors and queries, so that a partition with a third of
    all rows is many tasks."""
    spark = vectors.sparkSession
    p = params
    fine = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable())
    size = fine.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fine = fine.where(F.size("embedding") == size["d"])
    ask = queries.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable() & (F.size("embedding") == size["d"])).distinct()
    sample = fine.orderBy(F.xxhash64("vec_id"), "vec_id").limit(p.sample).select("embedding").toArrow()
    column = sample.column("embedding").combine_chunks()
    router = spark.sparkContext.broadcast(fit_router(unit_rows(_matrix(column)), p, size["count"]))
    shape = vectors.schema["embedding"].dataType.simpleString()
    shape = f"vec_id long, embedding {shape}, part int"
    base = durable(fine.mapInArrow(_assign(router, 1), shape), "ann-base")
    probe = durable(ask.mapInArrow(_assign(router, 0), shape), "ann-probe")
    n_base = {r["part"]: -(-r["count"] // p.chunk) for r in base.groupBy("part").count().collect()}  # at most p.parts rows
    n_ask = {r["part"]: -(-r["count"] // p.chunk) for r in probe.groupBy("part").count().collect()}

    def blocks(counts: dict[int, int]):
        return F.element_at(F.create_map(*(F.lit(x) for kv in (counts or {-1: 1}).items() for x in kv)), F.col("part"))

    def dealt(df: DataFrame, own: dict[int, int], other: dict[int, int], mine: str, others: str) -> DataFrame:
        d = df.withColumn(mine, F.pmod(F.xxhash64("vec_id"), blocks(own)).cast("int"))
        return d.withColumn(others, F.explode(F.sequence(F.lit(0), F.coalesce(blocks(other), F.lit(0)) - 1))).where(F.col(others) >= 0)

    both = {x for x in n_base if x in n_ask}
    base = dealt(base.where(F.col("part").isin(*both) if both else F.lit(False)), n_base, n_ask, "bb", "qb")
    probe = dealt(probe.where(F.col("part").isin(*both) if both else F.lit(False)), n_ask, n_base, "qb", "bb")
    probe = probe.withColumn("asked", F.xxhash64("embedding"))

    def compare(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            q, b = (_matrix(t.column("embedding").combine_chunks()) for t in (right, left))
            ids = right.column("vec_id").to_numpy()
            at, vec, score = best_of(q, ids, b, left.column("vec_id").to_numpy(), k)
            return pa.table({"query_id": ids[at], "asked": right.column("asked").to_numpy()[at], "vec_id": vec, "score": score})
        none = pa.array([], pa.int64())
        return pa.table({"query_id": none, "asked": none, "vec_id": none, "score": pa.array([], pa.float64())})

    cell = ["part", "bb", "qb"]
    found = base.groupBy(*cell).cogroup(probe.groupBy(*cell)).applyInArrow(compare, "query_id long, asked long, vec_id long, score double")
    order = Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

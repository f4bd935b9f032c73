"""Neighbours: large, small and repeated vectors, recall of the registered parameters, clustered tables."""

import numpy as np
import pytest

from tessera.llm import neighbours
from tessera.llm.queries import QUERIES
from test_other_operators import brute


def doubles(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, part int, asked string")


def ranks(got):
    out = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_large_and_small_components(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 6))
    x[:10] *= 1e200
    x[10:20] *= 1e-200
    x[20] = [1e-310, 0, 0, 0, 0, 0]
    x[21] = [1.7e308] * 6
    v = doubles(spark, [(i, x[i].tolist(), 0, "a") for i in range(40)])
    got = ranks(neighbours.search(v, v, 5).collect())
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    want = brute(unit, np.arange(40), 5)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-12)


def test_repeated_queries_and_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.5, 0.5]), (5, [-1.0, 0.0])]
    v = doubles(spark, [(i, e, 0, "a") for i, e in rows])
    asked = doubles(spark, [(1, [1.0, 0.0], 0, "a")] * 2 + [(7, [0.0, 1.0], 0, "a"), (7, [-1.0, 0.0], 0, "a")])
    got = neighbours.search(v, asked, 4).select("query_id", "rank", "vec_id").collect()
    assert sorted(tuple(r) for r in got if r["query_id"] == 1) == [(1, 1, 2), (1, 2, 2), (1, 3, 4), (1, 4, 3)]
    assert sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == 7) == [(1, 3), (1, 5), (2, 3), (2, 4), (3, 2), (3, 4), (4, 2), (4, 2)]


def test_recall_of_the_registered_query(spark, tiny):
    d = tiny.replace("sf0.001", "sf0.1")
    rows = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").collect()
    want = brute(np.array([r["embedding"] for r in rows], dtype=float), np.array([r["vec_id"] for r in rows]), 5)
    got = ranks(QUERIES["op7_neighbours"](spark, d).collect())
    asked = [q for q in want if q % 50 == 0]
    assert sorted(got) == asked and all(len(got[q]) == 5 for q in asked)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in asked) >= 0.9 * 5 * len(asked)


def test_parts_grow_and_clusters_need_few_probes():
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(80, 24))
    x = neighbours.unit_rows(centre[rng.integers(80, size=4000)] + 0.15 * rng.normal(size=(4000, 24)))
    p = neighbours.RouterParams()
    few, many = neighbours.fit_router(x, p, 4000), neighbours.fit_router(x, p, 160_000)
    assert few.parts == 16 and many.parts == 39
    assert few.probes < 0.3 * few.parts and many.probes < 0.3 * many.parts

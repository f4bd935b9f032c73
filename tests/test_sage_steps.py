"""Sampled training: what is drawn for all steps at once, and what is left of a step."""

from collections import Counter
from contextlib import closing

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import sampling
from tessera.operators.parameters import gcn_parameters
from tessera.plans import sage
from tessera.plans.graph import Graph

N, D, K = 40, 5, 3


@pytest.fixture(scope="module")
def g(spark):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, N, (300, 2)) if a != b]
    v = spark.createDataFrame([(i, rng.normal(size=D).tolist(), int(rng.integers(K)), 0) for i in range(N)], "vid long, feat array<double>, label int, part int").cache()
    return Graph(v, spark.createDataFrame(edges + edges[:40], "src long, dst long").cache())


def runs(spark, do) -> int:
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty(30_000)
    got = store.executionsList()
    last = max((got.apply(i).executionId() for i in range(got.size())), default=-1)
    do()
    bus.waitUntilEmpty(30_000)
    got = store.executionsList()
    return sum(got.apply(i).executionId() > last for i in range(got.size()))


def test_a_further_step_is_one_query(spark, g):
    def fit(batch):
        t = sage.SageTrainer(g, sage.SageOptions([D, 4, K], [3, 3], batch=batch, dropout=0.2))
        assert 0 <= t.fit().metrics[0]["acc"] <= 1
        t.close()

    few, many = runs(spark, lambda: fit(N)), runs(spark, lambda: fit(2))  # 26 training vertices: one step, and some 12
    assert many - few <= 2 * 13


def test_gradients_of_three_sampled_layers_with_dropout(spark, g):
    t = sage.SageTrainer(g, sage.SageOptions([D, 4, 4, K], [2, 3, 2], dropout=0.3))
    w = [p["w"] for p in gcn_parameters([D, 4, 4, K])]
    dealt = g.vertices.where("vid % 3 = 0").select(F.lit(4).alias("step"), "vid")
    with closing(t.steps(dealt, 7)) as steps:
        take = next(steps)
        grads, loss = take(w)
        assert loss > 0 and all(np.abs(x).max() > 0 for x in grads)
        for k, i, j in ((0, 1, 2), (1, 2, 1), (2, 3, 0)):
            at = []
            for e in (1e-5, -1e-5):
                m = [x.copy() for x in w]
                m[k][i, j] += e
                at.append(take(m)[1])
            assert (at[0] - at[1]) / 2e-5 == pytest.approx(grads[k][i, j], abs=1e-7)
        assert next(steps, None) is None
    t.close()


@pytest.mark.parametrize("replace", [False, True])
def test_drawn_rows_are_edges_and_loops(spark, g, replace):
    lists = sampling.in_lists(g.edges)
    edges = Counter((r["src"], r["dst"]) for r in g.edges.collect())
    assert Counter((r["src"], r["dst"]) for r in lists.select(F.explode("srcs").alias("src"), "dst").collect()) == edges
    degree = Counter()
    for (_, b), n in edges.items():
        degree[b] += n
    want = g.vertices.crossJoin(spark.range(3).selectExpr("CAST(id AS int) AS step", "id + 50 AS key")).select("step", "key", "vid")
    for k in (4, 1000):
        got = Counter()
        for r in sampling.drawn_rows(lists, sampling.list_sizes(lists), want, k, replace).collect():
            got[r["step"], r["src"], r["dst"]] += 1
            n = degree[r["dst"]]
            assert r["w"] == 1 / ((k if replace and n else min(k, n)) + 1)
        for step in range(3):
            one = Counter({(a, b): n for (s, a, b), n in got.items() if s == step})
            assert all(one[v, v] == 1 for v in range(N))
            into = Counter()
            for (a, b), n in one.items():
                if a != b:
                    into[b] += n
                    assert n <= edges[a, b] or replace and edges[a, b]
            assert all(into[v] == (k * (degree[v] > 0) if replace else min(k, degree[v])) for v in range(N))


def test_draws_are_even():
    key = np.arange(60_000)
    places, valid = sampling.drawn_places(np.full(len(key), 5), np.full(len(key), 3), key, 2)
    assert valid.all()
    seen = Counter(tuple(sorted(p)) for p in places.tolist())
    assert len(seen) == 10 and all(abs(n / len(key) - 0.1) < 0.01 for n in seen.values())


def test_hub_is_cut_into_lists(spark):
    n = 600_000
    lists = sampling.in_lists(spark.range(n).selectExpr("id AS src", "-1L AS dst")).cache()
    sizes = lists.select(F.size("srcs").alias("n"), "chunk").collect()
    assert sum(r["n"] for r in sizes) == n and max(r["n"] for r in sizes) <= sampling.ENTRIES and max(r["chunk"] for r in sizes) > 0
    want = spark.createDataFrame([(0, key, -1) for key in range(200)], "step int, key long, vid long")
    drawn = sampling.drawn_rows(lists, sampling.list_sizes(lists), want, 5).where("src >= 0").collect()
    assert len(drawn) == 1000 and len({r["src"] for r in drawn}) > 990
    lists.unpersist()

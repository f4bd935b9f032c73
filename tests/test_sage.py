"""Sampled training: with the whole neighbourhood a step equals NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.parameters import gcn_parameters
from tessera.plans import sage
from tessera.plans.graph import Graph

N, D, K = 30, 5, 3


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(4)
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, N, (120, 2)) if a != b})
    x, y = rng.normal(size=(N, D)), rng.integers(0, K, N)
    v = spark.createDataFrame([(i, x[i].tolist(), int(y[i]), 0) for i in range(N)], "vid long, feat array<double>, label int, part int").cache()
    a = np.eye(N)
    for s, t in edges:
        a[t, s] += 1
    return Graph(v, spark.createDataFrame(edges, "src long, dst long").cache()), a / a.sum(axis=1, keepdims=True), x, y


def test_step_and_inference_equal_numpy(spark, case):
    g, a, x, y = case
    w = [p["w"] for p in gcn_parameters([D, 4, K])]
    seeds = list(range(0, N, 3))
    m0 = a @ x
    h = np.maximum(m0 @ w[0], 0)
    m1 = a @ h
    z = m1 @ w[1]
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    d = np.zeros_like(p)
    d[seeds] = p[seeds]
    d[seeds, y[seeds]] -= 1
    d /= len(seeds)
    g1 = m1.T @ d
    g0 = m0.T @ ((a.T @ (d @ w[1].T)) * (h > 0))
    t = sage.SageTrainer(g, sage.SageOptions([D, 4, K], [100, 100]))
    grads, loss = t.step(spark.createDataFrame([(s,) for s in seeds], "vid long"), w, 0)
    assert loss == pytest.approx(-np.log(p[seeds, y[seeds]]).mean())
    assert grads[1] == pytest.approx(g1, abs=1e-9) and grads[0] == pytest.approx(g0, abs=1e-9)
    got = np.array([r["feat"] for r in sage.infer(g, w).orderBy("vid").collect()])
    assert got == pytest.approx(z, abs=1e-9)
    t.close()


def test_fit_and_edge_loss(spark, case):
    g, *_ = case
    t = sage.SageTrainer(g, sage.SageOptions([D, 4, K], [2, 2], batch=12, epochs=1, dropout=0.2))
    run = t.fit()
    t.close()
    assert len(run.metrics) == 1 and run.metrics[0]["n"] == N - int(N * 0.66) and 0 <= run.metrics[0]["acc"] <= 1
    w = [p["w"] for p in run.parameters]
    row = sage.edge_loss(g, w, g.edges.where(F.col("src") < 10)).first()
    assert row["n"] > 0 and row["loss"] > 0


def test_plans_of_a_step_stay_short(spark, case):
    g, *_ = case
    t = sage.SageTrainer(g, sage.SageOptions([D, 4, K], [2, 2], dropout=0.2))
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()

    def runs():
        bus.waitUntilEmpty(30_000)
        got = store.executionsList()
        return {got.apply(i).executionId(): len(got.apply(i).physicalPlanDescription()) for i in range(got.size())}

    before = runs()
    t.step(spark.createDataFrame([(s,) for s in range(0, N, 3)], "vid long"), [p["w"] for p in gcn_parameters([D, 4, K])], 0)
    t.close()
    assert max(n for i, n in runs().items() if i not in before) < 500_000

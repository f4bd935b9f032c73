"""Training against NumPy: whole epochs, finite differences, and what must not depend on the layout."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import construct as B
from tessera.operators.gather import gather
from tessera.operators.parameters import Adam, gat_parameters, gcn_parameters
from tessera.plans.graph import Graph
from tessera.plans.planner import plan_gcn
from tessera.plans.trainer import GatTrainer, GcnTrainer, Options

N, D_IN, K = 40, 6, 3


def data(seed=1):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, N, (200, 2)) if a != b]
    return edges, rng.normal(size=(N, D_IN)), rng.integers(0, K, N)


@pytest.fixture(scope="module")
def g(spark):
    edges, x, y = data()
    v = spark.createDataFrame([(i, x[i].tolist(), int(y[i]), 0) for i in range(N)], "vid long, feat array<double>, label int, part int").cache()
    return Graph(v, spark.createDataFrame(edges, "src long, dst long").cache())


def adjacency(edges):
    deg = np.ones(N)
    for _, b in edges:
        deg[b] += 1
    a = np.diag(1 / deg)
    for s, t in edges:
        a[t, s] += 1 / np.sqrt(deg[s] * deg[t])
    return a


def softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / (e.sum(axis=1, keepdims=True) + 1e-20)


def numpy_epoch(a, x, y, w):
    n_train, n_val = int(N * 0.66), int(N * 0.1)
    h, saved = x, []
    for k, m in enumerate(w):
        ah = a @ h
        z = ah @ m
        saved.append((ah, z))
        h = np.tanh(z) if k + 1 < len(w) else softmax(z)
    d = h.copy()
    d[np.arange(N), y] -= 1
    d[n_train:] = 0
    g, grads = d / (N * 0.66), [None] * len(w)
    for k in range(len(w) - 1, -1, -1):
        grads[k] = saved[k][0].T @ g
        if k:
            g = (a.T @ (g @ w[k].T)) * (1 - np.tanh(saved[k - 1][1]) ** 2)
    val = slice(n_train, n_train + n_val)
    loss = -np.log(h[np.arange(N), y][val]).mean()
    return grads, loss


@pytest.mark.parametrize("sizes", [[D_IN, 5, K], [D_IN, 4, 7, K]])
def test_gcn_training_equals_numpy(g, sizes):
    edges, x, y = data()
    a = adjacency(edges)
    w, opt, losses = [p["w"] for p in gcn_parameters(sizes)], Adam(0.01), []
    for _ in range(3):
        grads, loss = numpy_epoch(a, x, y, w)
        losses.append(loss)
        w = [opt.step((k, "w"), w[k], grads[k]) for k in range(len(w))]
        opt.end_step()
    t = GcnTrainer(g, Options(sizes, epochs=3))
    run = t.fit()
    t.close()
    assert [m["loss"] for m in run.metrics] == pytest.approx(losses, abs=1e-6)
    for mine, theirs in zip(run.parameters, w):
        assert mine["w"] == pytest.approx(theirs, abs=1e-6)


def test_gcn_gradient_by_finite_differences(g):
    edges, x, y = data()
    a = adjacency(edges)
    w = [p["w"] for p in gcn_parameters([D_IN, 5, K])]
    t = GcnTrainer(g, Options([D_IN, 5, K]))
    grads, _ = t.epoch(w)
    t.close()

    def loss(w):
        p = softmax(a @ np.tanh(a @ x @ w[0]) @ w[1])
        n = int(N * 0.66)
        return -np.log(p[np.arange(n), y[:n]]).sum() / (N * 0.66)

    for k, i, j in ((0, 0, 0), (0, 3, 2), (1, 1, 1)):
        up, down = [m.copy() for m in w], [m.copy() for m in w]
        up[k][i, j] += 1e-5
        down[k][i, j] -= 1e-5
        assert grads[k][i, j] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-6)


def test_gat_epoch_equals_numpy(g):
    edges, x, y = data()
    p = gat_parameters([D_IN, 4, K])
    h, saved = x, []
    for q in p:
        z = h @ q["w"]
        az = z @ q["a_i"]
        act = np.where(az > 0, az, 0.01 * az)
        m = np.eye(N)
        for s, t in edges:
            m[t, s] += act[t]
        saved.append((h, z, az, m))
        h = m @ z
    grad, want = softmax(h), [None] * 2
    grad[np.arange(N), y] -= 1
    for k in (1, 0):
        h, z, az, m = saved[k]
        slope = np.where(az > 0, 1, 0.01)
        indeg = np.bincount([t for _, t in edges], minlength=N)
        da = (z.T @ z) @ (grad * (slope * indeg)[:, None]).sum(axis=0)
        atg = m.T @ grad
        for s, t in edges:
            atg[t] += slope[t] * (grad[t] @ p[k]["a_i"]) * z[s]
        want[k] = (h.T @ atg, da)
        grad = atg @ p[k]["w"].T
    t = GatTrainer(g, Options([D_IN, 4, K]))
    got, _ = t.epoch(p)
    t.close()
    for k in range(2):
        assert got[k]["w"] == pytest.approx(want[k][0], abs=1e-6)
        assert got[k]["a_i"] == pytest.approx(want[k][1], abs=1e-6)


def test_gather_is_adjoint_and_layout_free(spark, g):
    w, own = B.normalize(g.vertices, g.edges)
    x = g.features()
    y = x.select("vid", F.reverse("feat").alias("feat"))
    m = lambda df: np.array([r["feat"] for r in df.orderBy("vid").collect()])
    a = (m(gather(w, x, own)) * m(y)).sum()
    b = (m(x) * m(gather(w, y, own, backward=True))).sum()
    assert a == pytest.approx(b)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    again = m(gather(w.repartition(7), x, own))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert again == pytest.approx(m(gather(w, x, own)))


def test_staleness_zero_is_synchronous_and_lag_changes_the_path(g):
    runs = []
    for s in (0, 0, 1):
        t = GcnTrainer(g, Options([D_IN, 4, K], epochs=3, staleness=s))
        runs.append(t.fit())
        t.close()
    assert [m["loss"] for m in runs[0].metrics] == pytest.approx([m["loss"] for m in runs[1].metrics], abs=1e-12)
    assert runs[0].metrics[2]["loss"] != runs[2].metrics[2]["loss"]


def test_early_stop(g):
    t = GcnTrainer(g, Options([D_IN, 4, K], epochs=5, target=0.0))
    assert len(t.fit().metrics) == 1
    t.close()


def test_planner_gathers_the_narrower_rows():
    assert [p.gathered for p in plan_gcn([64, 16, 10])] == [0, 10]
    assert [p.gathered for p in plan_gcn([16, 8, 32])] == [0, 8]


def test_partitioner_is_balanced_and_better_than_hash(spark):
    rng = np.random.default_rng(0)
    edges = []
    for c in range(4):
        edges += [(int(a) * 4 + c, int(b) * 4 + c) for a, b in rng.integers(0, 50, (600, 2))]
    e = spark.createDataFrame(edges, "src long, dst long")
    v = spark.range(200).select(F.col("id").alias("vid"))
    part = B.label_propagation(v, e, 4, rounds=6, slack=1.3)
    sizes = [r["count"] for r in part.groupBy("part").count().collect()]
    assert sum(sizes) == 200 and max(sizes) <= 66
    hashed = v.select("vid", B.hash_partition(F.col("vid"), 4).alias("part"))
    assert B.edge_cut(e, part).first()["cut"] <= B.edge_cut(e, hashed).first()["cut"]

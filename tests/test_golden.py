"""The hand graph: exact values of every construction and gather step."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators import construct as B, evaluate as G, layers as Y
from tessera.operators.dense import matmul
from tessera.operators.gather import attention_gather, gather
from tessera.operators.parameters import Adam, Convergence, SGD, State, xavier

EDGES = [(0, 1), (0, 2), (1, 2), (2, 0), (3, 2), (3, 2), (4, 4), (4, 3)]
X = np.array([[1, 0], [0, 1], [1, 1], [2, -1], [0, 3], [-1, 2]], dtype=float)


@pytest.fixture(scope="module")
def g(spark):
    v = spark.createDataFrame([(i, X[i].tolist(), i % 2, int(i > 2)) for i in range(6)], "vid long, feat array<double>, label int, part int").cache()
    e = B.drop_self_edges(spark.createDataFrame(EDGES, "src long, dst long")).cache()
    return v, e


def matrix(df, feat="feat"):
    rows = {r["vid"]: r[feat] for r in df.collect()}
    return np.array([rows[i] for i in sorted(rows)])


def test_degrees_and_norms(g):
    v, e = g
    assert e.count() == 7
    assert [r["deg"] for r in B.in_degree(v, e).orderBy("vid").collect()] == [1, 1, 4, 1, 0, 0]
    w, own = B.normalize(v, e)
    assert [r["w"] for r in own.orderBy("vid").collect()] == pytest.approx([0.5, 0.5, 0.2, 0.5, 1, 1])
    got = {(r["src"], r["dst"]): r["w"] for r in w.collect()}
    assert got[(0, 1)] == pytest.approx(0.5) and got[(3, 2)] == pytest.approx(0.316228, abs=1e-6) and got[(4, 3)] == pytest.approx(0.707107, abs=1e-6)
    assert w.where("src = 3 AND dst = 2").count() == 2


def test_gather_both_ways(g):
    v, e = g
    w, own = B.normalize(v, e)
    x = v.select("vid", "feat")
    forward = [[0.816228, 0.316228], [0.5, 0.5], [1.781139, -0.116228], [1, 1.62132], [0, 3], [-1, 2]]
    backward = [[0.816228, 0.816228], [0.316228, 0.816228], [0.516228, 0.2], [1.632456, 0.132456], [1.414214, 2.292893], [-1, 2]]
    assert matrix(gather(w, x, own)) == pytest.approx(np.array(forward), abs=1e-6)
    assert matrix(gather(w, x, own, backward=True)) == pytest.approx(np.array(backward), abs=1e-6)


def test_dense_variant(spark, g):
    v, e = g
    w, own = B.normalize(v, e, "out", dedup=True)
    want = [[0.741582, 0.408248], [0.408248, 0.5], [1.908248, 0.5], [1, 1], [0, 1.5], [-1, 2]]
    assert matrix(gather(w, v.select("vid", "feat"), own)) == pytest.approx(np.array(want), abs=1e-6)


def test_attention(g):
    v, e = g
    x = v.select("vid", "feat")
    scored = Y.gat_scores(e, matmul(x, np.eye(2)), np.array([0.5, -1]))
    az = {r["dst"]: r["az"] for r in scored.collect()}
    assert [az[i] for i in range(4)] == pytest.approx([0.5, -1, -0.5, 2])
    want = [[1.5, 0.5], [-0.01, 1], [0.975, 1.005], [2, 5], [0, 3], [-1, 2]]
    assert matrix(attention_gather(scored, x)) == pytest.approx(np.array(want), abs=1e-6)


def test_neighbour_softmax_sums_to_one(g):
    v, e = g
    scored = Y.neighbour_softmax(Y.gat_scores(e, v.select("vid", "feat"), np.array([0.5, -1])))
    assert all(r["t"] == pytest.approx(1) for r in scored.groupBy("dst").agg(F.sum("a").alias("t")).collect())


def test_partitions(g):
    v, e = g
    k = B.classify_edges(e, v).cache()
    ids = lambda df: sorted((r["part"], r["vid"]) for r in df.collect())
    assert ids(B.ghosts(k, "in")) == [(0, 3)] and ids(B.ghosts(k, "out")) == [(1, 2)]
    assert k.where("pdst = 0").count() == 6 and k.where("psrc = 0").count() == 4
    assert [r["vid"] for r in B.boundary_vertices(k).collect()] == [3]
    assert B.edge_cut(e, v).first()["cut"] == 1
    assert {(r["part"], r["vid"]): r["slot"] for r in B.ghost_slots(B.ghosts(k, "in"), v).collect()} == {(0, 3): 3}


def test_undirected_uses_one_degree_for_all(g):
    v, e = g
    out = B.preprocess(v, e, undirected=True)
    assert out["edges"].count() == 14
    assert {r["vid"]: r["n"] for r in out["csc"].collect()} == {r["vid"]: r["n"] for r in out["csr"].collect()}


def test_layouts(g):
    v, e = g
    assert [(r["offset"], r["n"]) for r in B.csc(v, e).orderBy("vid").collect()] == [(0, 1), (1, 1), (2, 4), (6, 1), (7, 0), (7, 0)]


@pytest.mark.parametrize("n, want", [(10, (6, 1, 3)), (250, (165, 25, 60)), (500, (330, 50, 120))])
def test_split_sizes(spark, n, want):
    v = spark.range(n).select(F.col("id").alias("vid"), F.lit(0).alias("part"))
    got = {r["split"]: r["count"] for r in G.split(G.chunk_positions(v)).groupBy("split").count().collect()}
    assert (got["train"], got["val"], got["test"]) == want


def test_softmax(spark):
    got = spark.range(1).select(A.softmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).alias("p")).first()["p"]
    assert got == pytest.approx([0.090031, 0.244728, 0.665241], abs=1e-6)


def test_adam_steps():
    opt, w = Adam(0.01), np.zeros(1)
    steps = []
    for _ in range(2):
        new = opt.step("w", w, np.array([0.1]))
        opt.end_step()
        steps.append(float(w[0] - new[0]))
        w = new
    assert steps == pytest.approx([0.00999968378, 0.00999977634], abs=1e-10)


def test_sgd_variants():
    w, g = np.ones(1), np.ones(1)
    assert SGD(0.1).step("w", w, g)[0] == pytest.approx(0.9)
    nesterov = SGD(0.1, momentum=0.9, nesterov=True)
    assert nesterov.step("w", w, g)[0] == pytest.approx(1 - 0.1 * 1.9)


def test_initializer_first_value():
    m = xavier(128, 41)
    assert m[0, 0] == pytest.approx(-0.16220869, abs=1e-7) and m.shape == (128, 41)


def test_convergence_only_moves_on():
    c = Convergence(0.9, 0.1)
    assert [c.see(a) for a in (0.5, 0.85, 0.7, 0.9)] == [State.EARLY, State.CLOSE, State.CLOSE, State.DONE]


def test_labels_out_of_range_raise(spark):
    with pytest.raises(Exception, match="label out of range"):
        spark.createDataFrame([(7,)], "label int").select(A.one_hot(F.col("label"), 3)).collect()

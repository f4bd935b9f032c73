"""Rows wider than one aggregate holds: the same sums as NumPy, and no row an element on the way."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.gather import MAX_COLUMNS, combine, gather

N, WIDTH = 100, 2 * MAX_COLUMNS + 7


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(3)
    x, e, w = rng.normal(size=(N, WIDTH)), rng.integers(0, N, (1000, 2)), rng.normal(size=1000)
    a = np.zeros((N, N))
    np.add.at(a, (e[:, 1], e[:, 0]), w)
    edges = spark.createDataFrame([(int(s), int(t), float(k)) for (s, t), k in zip(e, w)], "src long, dst long, w double")
    return edges, spark.createDataFrame([(i, x[i].tolist()) for i in range(N)], "vid long, feat array<double>"), a, x


def rows_of(df):
    return np.array([r["feat"] for r in df.orderBy("vid").collect()])


def test_wide_rows_equal_numpy(spark, case):
    edges, x, a, m = case
    own = x.select("vid", (F.col("vid") + 0.5).alias("w"))
    loops = np.diag(np.arange(N) + 0.5)
    assert rows_of(gather(edges, x, own)) == pytest.approx((a + loops) @ m)
    assert rows_of(gather(edges, x, own, F.col("w") * 2, backward=True, width=WIDTH)) == pytest.approx((2 * a.T + loops) @ m)
    both = x.unionByName(x.select("vid", F.transform("feat", lambda v: v + 1).alias("feat")))
    assert rows_of(combine(both, "vid", "feat", WIDTH, "mean")) == pytest.approx(m + 0.5)


def test_wide_rows_are_not_shuffled_by_element(spark, case):
    edges, x, *_ = case
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    gather(edges, x, width=WIDTH).write.format("noop").mode("overwrite").save()
    assert written() - before < N * WIDTH

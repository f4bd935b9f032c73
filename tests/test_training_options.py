"""What a run may be told beyond layer sizes: ReLU, dropout, a falling rate, test rows, earlier parameters."""

import numpy as np
import pytest

from tessera.operators.layers import dropout_mask
from tessera.operators.parameters import SGD, gcn_parameters
from tessera.plans.trainer import GcnTrainer, Options

from test_training import D_IN, K, N, adjacency, data, g, softmax  # noqa: F401


def plain_step(a, x, y, w, masks):
    n_train = int(N * 0.66)
    h, seen = x, []
    for k, m in enumerate(w):
        ah = a @ h
        z = ah @ m
        h = softmax(z) if k + 1 == len(w) else np.maximum(z, 0) * masks[k]
        seen.append((ah, z))
    d = h.copy()
    d[np.arange(N), y] -= 1
    d[n_train:] = 0
    back, grads = d / (N * 0.66), [None] * len(w)
    for k in range(len(w) - 1, -1, -1):
        grads[k] = seen[k][0].T @ back
        if k:
            back = (a.T @ (back @ w[k].T)) * (seen[k - 1][1] > 0) * masks[k - 1]
    return grads, h


@pytest.mark.parametrize("sizes", [[D_IN, 5, K], [D_IN, 4, 7, K]])
@pytest.mark.parametrize("share", [0.0, 0.4])
def test_relu_and_dropout_equal_numpy(g, sizes, share):  # noqa: F811
    edges, x, y = data()
    a, w = adjacency(edges), [p["w"] for p in gcn_parameters(sizes)]
    masks = [dropout_mask(np.arange(N), n, share, 3, 2, k) for k, n in enumerate(sizes[1:-1])]
    want, _ = plain_step(a, x, y, w, masks)
    t = GcnTrainer(g, Options(sizes, activation="relu", dropout=share, seed=3))
    got, m = t.epoch(w, 2)
    test = t.evaluate(w, "split = 'test'")
    t.close()
    for mine, theirs in zip(got, want):
        assert mine == pytest.approx(theirs, abs=1e-9)
    p = plain_step(a, x, y, w, [1.0] * len(w))[1][np.arange(N), y]
    low, high = int(N * 0.66), int(N * 0.66) + int(N * 0.1)
    assert m["loss"] == pytest.approx(-np.log(p[low:high]).mean())
    assert test["n"] == N - high and test["loss"] == pytest.approx(-np.log(p[high:]).mean())


def test_dropout_mask_keeps_its_share_and_differs_by_key():
    a, b = dropout_mask(np.arange(20000), 8, 0.3, 1, 0, 0), dropout_mask(np.arange(20000), 8, 0.3, 1, 1, 0)
    assert a.mean() == pytest.approx(1, abs=0.01) and set(np.unique(a)) == {0.0, 1 / 0.7}
    assert (a == b).mean() == pytest.approx(0.58, abs=0.01)
    assert (dropout_mask(np.arange(5), 8, 0.3, 1, 0, 0) == a[:5]).all()


def test_resumed_run_equals_one_run_and_rate_halves(g):  # noqa: F811
    def run(epochs, **kw):
        t = GcnTrainer(g, Options([D_IN, 4, K], epochs=epochs, **kw))
        got = t.fit()
        t.close()
        return got

    whole = run(3, optimizer=SGD(0.5))
    first = run(1, optimizer=SGD(0.5))
    rest = run(2, optimizer=SGD(0.5), initial=first.parameters)
    for a, b in zip(whole.parameters, rest.parameters):
        assert a["w"] == pytest.approx(b["w"], abs=1e-9)
    slow = run(2, optimizer=SGD(0.5), halve=1)
    by_hand = run(1, optimizer=SGD(0.25), initial=first.parameters)
    for a, b in zip(slow.parameters, by_hand.parameters):
        assert a["w"] == pytest.approx(b["w"], abs=1e-9)


def test_wrong_options_raise():
    for kw in ({"activation": "gelu"}, {"dropout": 0.5}, {"activation": "relu", "dropout": 1.0}):
        with pytest.raises(ValueError):
            Options([2, 2], **kw)

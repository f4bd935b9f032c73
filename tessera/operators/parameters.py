"""Initial parameters, optimizers and the convergence state; all on the driver, as large as the layers are."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

import numpy as np

SEED = 8888
# The linear congruential generator of the initializers.
LCG_A, LCG_M = 16807, 2147483647


def uniform_stream(n: int, seed: int = SEED) -> np.ndarray:
    """n numbers in [0, 1): x <- 16807 x mod (2^31 - 1), u = (x - 1) / (2^31 - 2)."""
    out, x = np.empty(n), seed
    for k in range(n):
        x = x * LCG_A % LCG_M
        out[k] = (x - 1) / (LCG_M - 1)
    return out


def xavier(rows: int, cols: int, seed: int = SEED) -> np.ndarray:
    """Uniform in +-sqrt(6 / (rows + cols)); the stream starts anew for each matrix."""
    return (2 * uniform_stream(rows * cols, seed) - 1).reshape(rows, cols) * np.sqrt(6 / (rows + cols))


def kaiming(rows: int, cols: int, seed: int = SEED) -> np.ndarray:
    """Normal with deviation sqrt(2 / rows)."""
    return np.random.default_rng(seed).normal(size=(rows, cols)) * np.sqrt(2 / rows)


def uniform(rows: int, cols: int, bound: float = 1.0, seed: int = SEED) -> np.ndarray:
    return (2 * uniform_stream(rows * cols, seed) - 1).reshape(rows, cols) * bound


def constant(n: int, value: float = 0.0) -> np.ndarray:
    return np.full(n, value)


INITIALIZERS = {"xavier": xavier, "kaiming": kaiming, "uniform": uniform}


def gcn_parameters(sizes: list[int], init: str = "xavier") -> list[dict[str, np.ndarray]]:
    return [{"w": INITIALIZERS[init](a, b)} for a, b in zip(sizes, sizes[1:])]


def gat_parameters(sizes: list[int], init: str = "xavier") -> list[dict[str, np.ndarray]]:
    """w and the attention vectors of each layer; a_j takes part in no score."""
    f = INITIALIZERS[init]
    return [{"w": f(a, b), "a_i": f(b, 1)[:, 0], "a_j": f(b, 1)[:, 0]} for a, b in zip(sizes, sizes[1:])]


@dataclass
class SGD:
    """Plain, momentum, Nesterov and weight-decay descent; noise adds N(0, noise) to the gradient, from a fixed seed."""

    rate: float = 0.01
    momentum: float = 0.0
    decay: float = 0.0
    nesterov: bool = False
    noise: float = 0.0
    seed: int = SEED
    _v: dict = field(default_factory=dict)

    def __post_init__(self):
        self._rng = np.random.default_rng(self.seed)

    def step(self, key, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        g = g + self.decay * w
        if self.noise:
            g = g + self._rng.normal(size=g.shape) * self.noise
        if self.momentum:
            v = self._v[key] = self.momentum * self._v[key] + g if key in self._v else g
            g = g + self.momentum * v if self.nesterov else v
        return w - self.rate * g

    def end_step(self) -> None:
        pass


@dataclass
class Adam:
    """beta 0.9 and 0.999, epsilon 1e-7; one step counter for all tensors, which moves on after a full update."""

    rate: float = 0.01
    beta1: float = 0.9
    beta2: float = 0.999
    epsilon: float = 1e-7
    decay: float = 0.0
    amsgrad: bool = False
    t: int = 1
    _m: dict = field(default_factory=dict)
    _v: dict = field(default_factory=dict)
    _top: dict = field(default_factory=dict)

    def step(self, key, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        g = g + self.decay * w
        m = self._m[key] = self.beta1 * self._m.get(key, 0.0) + (1 - self.beta1) * g
        v = self._v[key] = self.beta2 * self._v.get(key, 0.0) + (1 - self.beta2) * g * g
        if self.amsgrad:
            v = self._top[key] = np.maximum(v, self._top.get(key, 0.0))
        rate = self.rate * np.sqrt(1 - self.beta2**self.t) / (1 - self.beta1**self.t)
        return w - rate * m / (np.sqrt(v) + self.epsilon)

    def end_step(self) -> None:
        self.t += 1


def halve_every(rate: float, epoch: int, period: int = 50) -> float:
    """Learning rate halved after every period of epochs."""
    return rate * 0.5 ** (epoch // period)


class State(Enum):
    EARLY, CLOSE, DONE, FLUCT = range(4)


@dataclass
class Convergence:
    """DONE at the target accuracy, CLOSE within the threshold of it; never goes back."""

    target: float
    threshold: float = 0.0
    state: State = State.EARLY

    def see(self, accuracy: float) -> State:
        if accuracy >= self.target:
            self.state = State.DONE
        elif accuracy >= self.target - self.threshold and self.state is State.EARLY:
            self.state = State.CLOSE
        return self.state


def combine_gradients(parts: list[np.ndarray]) -> np.ndarray:
    return np.sum(parts, axis=0)

"""Row-wise linear algebra, activations and their gradients on array columns; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SOFTMAX_FLOOR = 1e-20
LEAKY_SLOPE = 0.01
#: Least probability under a logarithm: Spark's ln(0) is null.
LN_FLOOR = 1e-38


def as_double(x: Column | str) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def total(x: Column | str, seed: float = 0.0) -> Column:
    return F.aggregate(x, F.lit(float(seed)), lambda s, v: s + v)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def abs_sum(x: Column | str) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + F.abs(v))


# matrix with scalar and matrix with matrix, element by element


def scale(x: Column | str, k) -> Column:
    return F.transform(x, lambda v: v * k)


def divide(x: Column | str, k) -> Column:
    return F.transform(x, lambda v: v / k)


def shift(x: Column | str, k) -> Column:
    return F.transform(x, lambda v: v + k)


def power(x: Column | str, k) -> Column:
    return F.transform(x, lambda v: F.pow(v, F.lit(k)))


def add(a, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def hadamard(a, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def quotient(a, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x / y)


def axpy(a, x, y) -> Column:
    """a * x + y for a scalar a."""
    return F.zip_with(x, y, lambda u, v: a * u + v)


# activations


def tanh(x) -> Column:
    return F.transform(x, F.tanh)


def tanh_gradient(z) -> Column:
    return F.transform(z, lambda v: 1 - F.tanh(v) * F.tanh(v))


def sigmoid(x) -> Column:
    return F.transform(x, lambda v: 1 / (1 + F.exp(-v)))


def sigmoid_gradient(z) -> Column:
    return F.transform(z, lambda v: F.exp(-v) / F.pow(1 + F.exp(-v), F.lit(2.0)))


def relu(x) -> Column:
    return F.transform(x, lambda v: F.greatest(v, F.lit(0.0)))


def relu_gradient(z) -> Column:
    return F.transform(z, lambda v: F.when(v > 0, 1.0).otherwise(0.0))


def leaky(v: Column, slope: float = LEAKY_SLOPE) -> Column:
    return F.when(v > 0, v).otherwise(v * slope)


def leaky_gradient(v: Column, slope: float = LEAKY_SLOPE) -> Column:
    return F.when(v > 0, F.lit(1.0)).otherwise(F.lit(float(slope)))


def leaky_relu(x, slope: float = LEAKY_SLOPE) -> Column:
    return F.transform(x, lambda v: leaky(v, slope))


def leaky_relu_gradient(x, slope: float = LEAKY_SLOPE) -> Column:
    return F.transform(x, lambda v: leaky_gradient(v, slope))


def softmax(x) -> Column:
    """Shifted by the row's maximum; the denominator starts from SOFTMAX_FLOOR."""
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / total(e, SOFTMAX_FLOOR))


def softmax_gradient(s, v) -> Column:
    """The helper s / v - s."""
    return F.zip_with(s, v, lambda a, b: a / b - a)


def one_hot(label: Column, kinds: int) -> Column:
    """Raises if a label is not in 0 .. kinds - 1."""
    checked = F.when((label >= 0) & (label < kinds), label).otherwise(F.raise_error(F.concat(F.lit("label out of range: "), label.cast("string"))).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(kinds - 1)), lambda k: (k == checked).cast("double"))


def argmax(x) -> Column:
    """Index of the first maximum, from 0."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def cross_entropy(p, label: Column) -> Column:
    return -F.ln(F.greatest(F.get(p, label), F.lit(LN_FLOOR)))


def log_softmax_loss(x, label: Column) -> Column:
    """Unshifted softmax cross-entropy."""
    return F.ln(total(F.transform(x, F.exp))) - F.get(x, label)


def shifted_loss(x, label: Column) -> Column:
    """Cross-entropy of softmax(x - max) + 1e-20."""
    return -F.ln(F.get(softmax(x), label) + F.lit(SOFTMAX_FLOOR))

"""Column expressions over scalars and array<double> vectors; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scale(a: Column, by: float | Column) -> Column:
    return F.transform(a, lambda x: x * by)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def hadamard(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def rbf(a: Column, b: Column, gamma: float) -> Column:
    return F.exp(F.lit(-gamma) * squared_distance(a, b))


def sigmoid(x: Column) -> Column:
    """Saturates beyond +-500."""
    return F.when(x > 500, F.lit(1.0)).when(x < -500, F.lit(0.0)).otherwise(1.0 / (1.0 + F.exp(-x)))


def softmax(scores: Sequence[Column]) -> list[Column]:
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    exps = [F.exp(s - top) for s in scores]
    total = sum(exps[1:], exps[0])
    return [e / total for e in exps]


def activation(x: Column, kind: str) -> Column:
    forms = {
        "identity": lambda: x,
        "sigmoid": lambda: sigmoid(x),
        "tanh": lambda: F.tanh(x),
        "relu": lambda: F.greatest(x, F.lit(0.0)),
        "leaky_relu": lambda: F.when(x > 0, x).otherwise(0.01 * x),
    }
    return forms[kind]()


def activation_derivative(x: Column, kind: str) -> Column:
    """Of the activation's input."""
    s = sigmoid(x)
    forms = {
        "identity": lambda: F.lit(1.0),
        "sigmoid": lambda: s * (1 - s),
        "tanh": lambda: 1 - F.tanh(x) * F.tanh(x),
        "relu": lambda: (x > 0).cast("double"),
        "leaky_relu": lambda: F.when(x > 0, 1.0).otherwise(0.01),
    }
    return forms[kind]()


def matrix_vector(rows: Sequence[Sequence[float]], v: Column) -> Column:
    """The product of a constant matrix and an array column."""
    return F.array(*[dot(F.array(*[F.lit(float(x)) for x in row]), v) for row in rows])


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n keys."""
    import math

    return 0.0 if n <= 1 else 1.0 if n == 2 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def soft_threshold(rho: Column, alpha: float) -> Column:
    return F.when(rho > alpha, rho - alpha).when(rho < -alpha, rho + alpha).otherwise(F.lit(0.0))


def log_gaussian(x: Column, mean: float, var: float) -> Column:
    import math

    return F.lit(-0.5 * math.log(2 * math.pi * var)) - (x - mean) * (x - mean) / (2 * var)


def linear(features: Sequence[str | Column], weights: Sequence[float], intercept: float = 0.0) -> Column:
    out = F.lit(float(intercept))
    for f, w in zip(features, weights, strict=True):
        out = out + (F.col(f) if isinstance(f, str) else f) * float(w)
    return out


def argmax(scores: Sequence[Column], values: Sequence[int]) -> Column:
    """The value of the first largest score."""
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    out = F.lit(None).cast("int")
    for s, v in reversed(list(zip(scores, values, strict=True))):
        out = F.when(s == best, F.lit(int(v))).otherwise(out)
    return out

"""Linear models from one pass of sufficient statistics; solvers work on the p x p Gram matrix on the driver."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.functions.vectors import argmax, linear, sigmoid, softmax
from loomstat.operators.estimator import Callback, Estimator, TrainingHistory


WIDE = 24  # beyond so many columns the sums of pairs are made by blocks, not by an expression each


def moments(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """n, means and the centred cross products / n over the rows without a null among the columns."""
    p = len(columns)
    rows = df.select(*[F.col(c).cast("double").alias(f"m{i}_") for i, c in enumerate(columns)]).dropna()
    names = rows.columns
    if p > WIDE:
        return _wide_moments(rows)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    row = rows.agg(F.count(F.lit(1)), *[F.avg(c) for c in names], *[F.covar_pop(names[i], names[j]) for i, j in pairs]).first()
    if not row[0]:
        raise ValueError("there are no complete rows")
    cov = np.zeros((p, p))
    for (i, j), v in zip(pairs, row[1 + p :], strict=True):
        cov[i, j] = cov[j, i] = v
    return row[0], np.array(row[1 : 1 + p], float), cov


def _wide_moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    p = len(rows.columns)
    first = rows.agg(F.count(F.lit(1)), *[F.avg(c) for c in rows.columns]).first()
    if not first[0]:
        raise ValueError("there are no complete rows")
    n, mean = first[0], np.array(first[1:], float)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((p, p))
        for b in batches:
            x = b.to_numpy(float) - mean
            total += x.T @ x
        i, j = np.triu_indices(p)
        yield pd.DataFrame({"i": i, "j": j, "v": total[i, j]})

    cov = np.zeros((p, p))
    for i, j, v in rows.mapInPandas(blocks, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():
        cov[i, j] = cov[j, i] = v / n
    return n, mean, cov


def solved(gram: np.ndarray, target: np.ndarray, least: float = 1e-10) -> np.ndarray:
    """gram @ w = target for a symmetric matrix; dependent columns are found on the matrix scaled to a unit diagonal."""
    size = np.sqrt(np.diag(gram))
    if (size <= 0).any() or np.linalg.eigvalsh(gram / np.outer(size, size)).min() < least:
        raise ValueError("the features are linearly dependent")
    return np.linalg.solve(gram / np.outer(size, size), target / size) / size


@dataclass
class LinearModel(Estimator):
    learned = ("weights", "intercept")
    regression = True
    features: Sequence[str]
    label: str
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = 0.0

    def predict(self) -> Column:
        return linear(self.features, self.weights, self.intercept)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self.predict())


@dataclass
class LinearRegression(LinearModel):
    """closed: normal equations. gd: full gradient steps from 0 on the Gram matrix, so data are read once."""

    solver: str = "closed"
    learning_rate: float = 0.01
    max_iter: int = 1000
    tol: float = 1e-4
    fit_intercept: bool = True

    def fit(self, df: DataFrame, history: TrainingHistory | None = None, callback: Callback | None = None) -> LinearRegression:
        columns = [*self.features, self.label]
        _, mean, cov = moments(df, columns)
        if self.fit_intercept and self.solver == "closed":
            self.weights = solved(cov[:-1, :-1], cov[:-1, -1])
            self.intercept = float(mean[-1] - self.weights @ mean[:-1])
            return self
        second = cov + np.outer(mean, mean)
        if self.fit_intercept:
            second = np.block([[np.ones((1, 1)), mean[None, :]], [mean[:, None], second]])
        gram, target, power = second[:-1, :-1], second[:-1, -1], second[-1, -1]
        if self.solver == "closed":
            w = solved(gram, target)
        else:
            w, last = np.zeros(len(target)), None
            for epoch in range(self.max_iter):
                loss = w @ gram @ w - 2 * w @ target + power
                w = w - self.learning_rate * (gram @ w - target)
                self.report(history, callback, epoch, loss)
                if last is not None and abs(last - loss) < self.tol:
                    break
                last = loss
        self.intercept, self.weights = (float(w[0]), w[1:]) if self.fit_intercept else (0.0, w)
        return self


@dataclass
class Ridge(LinearModel):
    """Centred; alpha isn't divided by n and doesn't act on the intercept."""

    alpha: float = 1.0

    def fit(self, df: DataFrame) -> Ridge:
        n, mean, cov = moments(df, [*self.features, self.label])
        self.weights = np.linalg.solve(n * cov[:-1, :-1] + self.alpha * np.eye(len(self.features)), n * cov[:-1, -1])
        self.intercept = float(mean[-1] - self.weights @ mean[:-1])
        return self


@dataclass
class Lasso(LinearModel):
    """Cyclic coordinate descent on centred moments."""

    alpha: float = 1.0
    max_iter: int = 1000
    tol: float = 1e-6

    def fit(self, df: DataFrame) -> Lasso:
        _, mean, cov = moments(df, [*self.features, self.label])
        p = len(self.features)
        w = np.zeros(p)
        for _ in range(self.max_iter):
            before = w.copy()
            for j in range(p):
                if cov[j, j] < 1e-12:
                    w[j] = 0.0
                    continue
                rho = cov[j, -1] - cov[j, :p] @ w + cov[j, j] * w[j]
                w[j] = np.sign(rho) * max(abs(rho) - self.alpha, 0.0) / cov[j, j]
            if np.abs(w - before).max() < self.tol:
                break
        self.weights, self.intercept = w, float(mean[-1] - w @ mean[:-1])
        return self


@dataclass
class LogisticRegression(Estimator):
    """Full-batch gradient steps from 0 without intercept: one aggregate of p sums for each step."""

    learned = ("weights",)

    features: Sequence[str]
    label: str
    learning_rate: float = 0.1
    max_iter: int = 1000
    l2: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def fit(self, df: DataFrame) -> LogisticRegression:
        data = df.select(*self.features, self.label).dropna().persist()
        w = np.zeros(len(self.features))
        for _ in range(self.max_iter):
            error = sigmoid(linear(self.features, w)) - F.col(self.label)
            gradient = np.array(data.agg(*[F.avg(error * F.col(f)) for f in self.features]).first(), float)
            w = w - self.learning_rate * (gradient + self.l2 * w)
        data.unpersist()
        self.weights = w
        return self

    def probability(self) -> Column:
        return sigmoid(linear(self.features, self.weights))

    def transform(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        return df.withColumn("probability", self.probability()).withColumn("prediction", (F.col("probability") >= threshold).cast("int"))


@dataclass
class SoftmaxRegression(Estimator):
    """Gradient steps from 0 with biases; stops when no gradient entry reaches tol."""

    learned = ("weights",)

    features: Sequence[str]
    label: str
    classes: int
    learning_rate: float = 0.1
    max_iter: int = 1000
    tol: float = 1e-6
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))  # classes x (bias, features)

    def _scores(self, w: np.ndarray) -> list[Column]:
        return [linear(self.features, row[1:], row[0]) for row in w]

    def fit(self, df: DataFrame) -> SoftmaxRegression:
        data = df.select(*self.features, self.label).dropna().persist()
        w = np.zeros((self.classes, len(self.features) + 1))
        for _ in range(self.max_iter):
            errors = [p - (F.col(self.label) == c).cast("double") for c, p in enumerate(softmax(self._scores(w)))]
            sums = data.agg(*[F.avg(e * x) for e in errors for x in [F.lit(1.0), *map(F.col, self.features)]]).first()
            gradient = np.array(sums, float).reshape(w.shape)
            w = w - self.learning_rate * gradient
            if np.abs(gradient).max() < self.tol:
                break
        data.unpersist()
        self.weights = w
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        scores = self._scores(self.weights)
        return df.withColumn("probabilities", F.array(*softmax(scores))).withColumn("prediction", argmax(scores, range(self.classes)))

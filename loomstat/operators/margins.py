"""Linear models by averaged (sub)gradients: linear support vectors and the losses of stochastic descent.

Each epoch is one aggregate over the rows whose p + 2 sums come to the driver; the trajectory doesn't depend on the order or the
partitioning of rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.functions.vectors import linear
from loomstat.operators.estimator import Callback, Estimator, TrainingHistory

LOSSES = ("squared", "log", "hinge", "huber")
HUBER = 1.0


def loss_and_slope(loss: str, score: Column, y: Column) -> tuple[Column, Column]:
    """The loss and its derivative by the score. hinge takes labels -1 and 1, log takes 0 and 1."""
    e = score - y
    if loss == "squared":
        return e * e / 2, e
    if loss == "huber":
        small = F.abs(e) <= HUBER
        return F.when(small, e * e / 2).otherwise(HUBER * (F.abs(e) - HUBER / 2)), F.when(small, e).otherwise(HUBER * F.signum(e))
    if loss == "hinge":
        inside = y * score < 1
        return F.when(inside, 1 - y * score).otherwise(0.0), F.when(inside, -y).otherwise(0.0)
    if loss == "log":
        return F.greatest(score, F.lit(0.0)) - score * y + F.log1p(F.exp(-F.abs(score))), 1 / (1 + F.exp(-score)) - y
    raise ValueError(f"loss must be one of {LOSSES}")


@dataclass
class GradientLinear(Estimator):
    """w -= rate_t (mean slope x + alpha w), rate_t = rate / (1 + alpha t); the intercept isn't penalised; stops when the loss moves less than tol.

    Rows with a null feature or label aren't used. No rows leave the weights 0."""

    learned = ("weights", "intercept", "epochs")

    features: Sequence[str]
    label: str
    loss: str = "squared"
    alpha: float = 1e-4
    learning_rate: float = 0.01
    max_iter: int = 1000
    tol: float = 1e-6
    fit_intercept: bool = True
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = 0.0
    epochs: int = 0

    def _target(self) -> Column:
        y = F.col(self.label).cast("double")
        return F.when(y > 0, 1.0).otherwise(-1.0) if self.loss == "hinge" else y

    @property
    def task(self) -> str:
        return "classification" if self.loss in ("log", "hinge") else "regression"

    def fit(self, df: DataFrame, history: TrainingHistory | None = None, callback: Callback | None = None) -> GradientLinear:
        rows = df.select(*[F.col(f).cast("double").alias(f) for f in self.features], self._target().alias("y_"), F.col(self.label).alias("given_")).dropna().drop("given_").cache()
        try:
            self.weights, self.intercept, last = np.zeros(len(self.features)), 0.0, None
            for t in range(self.max_iter):
                value, slope = loss_and_slope(self.loss, self.margin(), F.col("y_"))
                row = rows.select(*self.features, value.alias("loss_"), slope.alias("slope_")).agg(F.avg("loss_"), F.avg("slope_"), *[F.avg(F.col("slope_") * F.col(f)) for f in self.features]).first()
                if row[0] is None:
                    break
                loss = row[0] + self.alpha / 2 * float(self.weights @ self.weights)
                rate = self.learning_rate / (1 + self.alpha * t)
                self.weights = self.weights - rate * (np.array(row[2:], float) + self.alpha * self.weights)
                self.intercept -= rate * row[1] if self.fit_intercept else 0.0
                self.epochs = t + 1
                self.report(history, callback, t, loss)
                if last is not None and abs(last - loss) < self.tol:
                    break
                last = loss
        finally:
            rows.unpersist()
        return self

    def margin(self) -> Column:
        return linear(self.features, self.weights, self.intercept)

    def transform(self, df: DataFrame) -> DataFrame:
        """score and prediction: a class 0 or 1 for log and hinge, else the score."""
        out = df.withColumn("score", self.margin())
        return out.withColumn("prediction", (F.col("score") >= 0).cast("int") if self.loss in ("log", "hinge") else F.col("score"))


@dataclass
class LinearSVC(GradientLinear):
    """Hinge loss weighted by c against half the squared weights: the same steps with alpha 1 / c."""

    loss: str = "hinge"
    c: float = 1.0
    learning_rate: float = 0.1
    max_iter: int = 200

    def fit(self, df: DataFrame, history: TrainingHistory | None = None, callback: Callback | None = None) -> LinearSVC:
        self.alpha = 1.0 / self.c
        super().fit(df, history, callback)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = super().transform(df)
        return out.withColumn("probability", 1 / (1 + F.exp(-F.col("score"))))

"""Multinomial naive Bayes from grouped sums."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.functions.vectors import argmax, linear, softmax
from loomstat.operators.estimator import Estimator


@dataclass
class MultinomialNB(Estimator):
    """theta = ln((sum x + alpha) / (sum of all + alpha p)); priors aren't smoothed. Rows with a null aren't learnt from."""

    learned = ("classes", "weights", "priors")

    features: Sequence[str]
    label: str
    alpha: float = 1.0
    classes: list[int] = field(default_factory=list)
    weights: list[list[float]] = field(default_factory=list)
    priors: list[float] = field(default_factory=list)

    def fit(self, df: DataFrame) -> MultinomialNB:
        rows = df.dropna(subset=[*self.features, self.label]).groupBy(F.col(self.label).cast("int").alias("c")).agg(F.count(F.lit(1)), *[F.sum(f) for f in self.features]).orderBy("c").collect()
        n, p = sum(r[1] for r in rows), len(self.features)
        self.classes = [r[0] for r in rows]
        self.priors = [math.log(r[1] / n) for r in rows]
        self.weights = [[math.log((x + self.alpha) / (sum(r[2:]) + self.alpha * p)) for x in r[2:]] for r in rows]
        return self

    def scores(self) -> list[Column]:
        return [linear(self.features, w, b) for w, b in zip(self.weights, self.priors, strict=True)]

    def transform(self, df: DataFrame) -> DataFrame:
        self.check_fitted()
        scores = self.scores()
        return df.withColumn("probabilities", F.array(*softmax(scores))).withColumn("prediction", argmax(scores, self.classes))

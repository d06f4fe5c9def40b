"""Support vector classifiers. The linear one scales; the RBF one holds a kernel matrix of a bounded number of rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.operators.estimator import Estimator
from loomstat.operators.margins import LinearSVC


@dataclass
class SVMClassifier(Estimator):
    """kernel linear: LinearSVC's steps. rbf: projected ascent of the dual (labels 0/1 or -1/1) on the kernel of at most `most` rows, which
    the driver holds; more rows are refused, not sampled. gamma None is 1 / number of features. Rows with a null aren't used."""

    learned = ("vectors", "alphas", "linear")

    features: Sequence[str]
    label: str
    kernel: str = "rbf"
    c: float = 1.0
    gamma: float | None = None
    learning_rate: float = 0.1
    max_iter: int = 300
    most: int = 4000
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    alphas: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    linear: LinearSVC | None = None

    def fit(self, df: DataFrame) -> SVMClassifier:
        if self.kernel == "linear":
            self.linear = LinearSVC(self.features, self.label, c=self.c, learning_rate=self.learning_rate, max_iter=self.max_iter).fit(df)
            return self
        rows = df.select(*[F.col(f).cast("double").alias(f) for f in self.features], F.col(self.label).cast("double").alias("y_")).dropna()
        held = rows.limit(self.most + 1).toPandas()
        if len(held) > self.most:
            raise ValueError(f"an RBF kernel is held for at most {self.most} rows")
        held = held.sort_values(list(held.columns))
        x, y = held[list(self.features)].to_numpy(float), np.where(held["y_"] > 0, 1.0, -1.0)
        gamma = self._gamma()
        q = np.exp(-gamma * ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)) if len(x) * len(x) * max(1, x.shape[1]) < 5e7 else _kernel(x, x, gamma)
        # a bias as a constant feature; steps within the curvature's bound
        q = (q + 1.0) * np.outer(y, y)
        rate = min(self.learning_rate, 1.0 / max(1e-12, np.abs(q).sum(axis=1).max())) if len(x) else 0.0
        alpha = np.zeros(len(x))
        for _ in range(self.max_iter * 10):
            new = np.clip(alpha + rate * (1 - q @ alpha), 0.0, self.c)
            moved = np.abs(new - alpha).max(initial=0.0)
            alpha = new
            if moved < 1e-7:
                break
        kept = alpha > 1e-6
        self.vectors, self.alphas = x[kept], (alpha * y)[kept]
        self.bias = float(self.alphas.sum())
        return self

    def _gamma(self) -> float:
        return self.gamma if self.gamma is not None and self.gamma > 0 else 1.0 / len(self.features)

    def transform(self, df: DataFrame) -> DataFrame:
        """score, probability and prediction 0 or 1."""
        if self.kernel == "linear":
            return self.linear.transform(df)
        vectors, alphas, bias, gamma = self.vectors, self.alphas, self.bias, self._gamma()

        @F.pandas_udf("double")
        def margin(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in batches:
                # one column comes bare
                columns = (columns,) if isinstance(columns, pd.Series) else columns
                x = np.column_stack([c.to_numpy(float) for c in columns])
                yield pd.Series(_kernel(x, vectors, gamma) @ alphas + bias if len(alphas) else np.zeros(len(x)))

        out = df.withColumn("score", margin(*[F.col(f).cast("double") for f in self.features]))
        out = out.withColumn("score", F.when(F.isnan("score"), None).otherwise(F.col("score")))
        return out.withColumn("probability", 1 / (1 + F.exp(-F.col("score")))).withColumn("prediction", (F.col("score") >= 0).cast("int"))


def _kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(squares, 0.0))


def kernel_matrix(df: DataFrame, features: Sequence[str], gamma: float, vectors: DataFrame, most: int = 10_000) -> DataFrame:
    """id, other, value: the RBF kernel of each row against a table of at most `most` rows (both with id)."""
    if vectors.limit(most + 1).count() > most:
        raise ValueError(f"at most {most} rows on the kernel's second side")
    other = F.broadcast(vectors.select(F.col("id").alias("other"), *[F.col(f).alias(f"o_{f}") for f in features]))
    squares = sum(((F.col(f) - F.col(f"o_{f}")) * (F.col(f) - F.col(f"o_{f}")) for f in features), F.lit(0.0))
    return df.crossJoin(other).select("id", "other", F.exp(-gamma * squares).alias("value"))

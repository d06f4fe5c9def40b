"""Principal components from one covariance aggregate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import moments


@dataclass
class PCA:
    """Centred; covariance over n - 1; the largest loading of each component is positive. whiten divides by the singular value."""

    columns: Sequence[str]
    n_components: int = 0
    whiten: bool = False
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    components: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    variance: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ratio: np.ndarray = field(default_factory=lambda: np.zeros(0))
    singular: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def fit(self, df: DataFrame) -> PCA:
        n, self.mean, cov = moments(df, self.columns)
        values, vectors = np.linalg.eigh(cov * (n / max(n - 1, 1)))
        order = np.argsort(-values)
        k = self.n_components if 0 < self.n_components <= len(order) else len(order)
        total = values.sum()
        self.variance, loadings = np.maximum(values[order][:k], 0.0), vectors[:, order[:k]].T
        signs = np.sign(loadings[np.arange(k), np.abs(loadings).argmax(axis=1)])
        self.components = loadings * np.where(signs == 0, 1.0, signs)[:, None]
        self.ratio = self.variance / total if total > 0 else np.zeros(k)
        self.singular = np.sqrt(self.variance * max(n - 1, 1))
        return self

    def transform(self, df: DataFrame, *keep: str) -> DataFrame:
        out = []
        for i, row in enumerate(self.components):
            by = float(self.singular[i]) if self.whiten and self.singular[i] > 0 else 1.0
            terms = [(F.col(c) - float(m)) * float(w) for c, m, w in zip(self.columns, self.mean, row, strict=True)]
            out.append((sum(terms[1:], terms[0]) / by).alias(f"pc{i}"))
        return df.select(*keep, *out)

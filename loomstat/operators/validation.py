"""Cross-validation, parameter grids and pipelines over models with fit(df) and transform(df)."""

from __future__ import annotations

import copy
import itertools
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.operators.estimator import Estimator, NotFittedError, accuracy, r_squared
from loomstat.operators.preprocess import kfold, stratified_kfold, subsample


@dataclass
class Scores:
    folds: list[float]

    @property
    def mean(self) -> float:
        return sum(self.folds) / len(self.folds) if self.folds else math.nan

    @property
    def std(self) -> float:
        """Of the population."""
        return math.sqrt(sum((x - self.mean) ** 2 for x in self.folds) / len(self.folds)) if self.folds else math.nan


def cross_val_score(make: Callable[[], Any], df: DataFrame, key: str, label: str, folds: int = 5, score: Callable[[DataFrame, str], float] = accuracy, stratified: bool = False, seed: int | None = None) -> Scores:
    """A fresh model fitted without each fold and scored on it. Fold numbers are kept for all fits; folds without rows are left out."""
    dealt = (stratified_kfold(df, key, label, folds) if stratified else kfold(df, key, folds, seed)).persist()
    try:
        filled = {r[0] for r in dealt.select("fold").distinct().collect()}
        return Scores([score(make().fit(dealt.where(F.col("fold") != i)).transform(dealt.where(F.col("fold") == i)), label) for i in range(folds) if i in filled])
    finally:
        dealt.unpersist()


def combinations(grid: Mapping[str, Sequence[Any]]) -> Iterator[dict[str, Any]]:
    """All settings; the last parameter changes fastest."""
    for values in itertools.product(*grid.values()):
        yield dict(zip(grid, values, strict=True))


@dataclass
class GridSearch:
    """Cross-validates every setting of make(**setting), then refits the first with the highest mean on all rows."""

    make: Callable[..., Any]
    grid: Mapping[str, Sequence[Any]]
    key: str
    label: str
    folds: int = 5
    score: Callable[[DataFrame, str], float] = accuracy
    seed: int = 42
    results: list[tuple[dict[str, Any], Scores]] = field(default_factory=list)
    best: dict[str, Any] = field(default_factory=dict)
    model: Any = None

    def fit(self, df: DataFrame) -> GridSearch:
        self.results = [(s, cross_val_score(lambda s=s: self.make(**s), df, self.key, self.label, self.folds, self.score, seed=self.seed)) for s in combinations(self.grid)]
        self.best = max(self.results, key=lambda x: x[1].mean)[0]
        self.model = self.make(**self.best).fit(df)
        return self

    def ranks(self) -> list[int]:
        """1 for the highest mean; equal means share a rank."""
        means = [s.mean for _, s in self.results]
        return [1 + sum(other > m for other in means) for m in means]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)


@dataclass
class Pipeline(Estimator):
    """Steps with fit and transform, each fitted on what those before it give; the last may be a model. transform is one plan."""

    steps: list[tuple[str, Any]]
    done: bool = False

    learned = ("done",)

    @property
    def label(self) -> str:
        return self.steps[-1][1].label

    @property
    def task(self) -> str:
        last = self.steps[-1][1]
        return getattr(last, "task", None) or ("regression" if getattr(last, "regression", False) else "classification")

    def fitted(self) -> bool:
        return self.done

    def clone(self) -> Pipeline:
        return Pipeline([(name, step.clone() if hasattr(step, "clone") else copy.deepcopy(step)) for name, step in self.steps])

    def predict(self, df: DataFrame) -> DataFrame:
        if not self.done:
            raise NotFittedError("the pipeline isn't fitted")
        out = self.transform(df)
        if "prediction" not in out.columns:
            raise ValueError("the pipeline's last step is no model")
        return out

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def fit(self, df: DataFrame) -> Pipeline:
        if not self.steps:
            raise ValueError("a pipeline needs a step")
        for i, (_, step) in enumerate(self.steps):
            step.fit(df)
            if i < len(self.steps) - 1:
                df = step.transform(df)
        self.done = True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for _, step in self.steps:
            df = step.transform(df)
        return df


def leave_one_out(make: Callable[[], Any], df: DataFrame, key: str, label: str, score: Callable[[DataFrame, str], float] = accuracy, most: int = 1000) -> Scores:
    """As many folds as rows, each a fit: for small tables, at most `most` rows. Linear models have leave_one_out_errors."""
    n = df.count()
    if n > most:
        raise ValueError(f"leaving one of {n} rows out means {n} fits; at most {most}")
    return cross_val_score(make, df, key, label, max(2, n), score)


def leave_one_out_errors(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Rows with `loo_error`: label less the prediction of the least-squares fit (with intercept) without the row, e / (1 - h), from one fit."""
    import numpy as np

    from loomstat.operators.linear import LinearRegression, moments

    n, mean, cov = moments(df, [*features, label])
    model = LinearRegression(features, label).fit(df)
    inverse = np.linalg.inv(cov[:-1, :-1]) / n
    centred = [F.col(f) - float(m) for f, m in zip(features, mean, strict=False)]
    leverage = sum((centred[i] * centred[j] * float(inverse[i, j]) for i in range(len(features)) for j in range(len(features))), F.lit(1.0 / n))
    return df.withColumn("loo_error", (F.col(label) - model.predict()) / (1 - leverage))


def learning_curve(make: Callable[[], Any], df: DataFrame, key: str, label: str, sizes: Sequence[float] = (0.1, 0.325, 0.55, 0.775, 1.0), folds: int = 5, score: Callable[[DataFrame, str], float] = accuracy, seed: int = 42) -> DataFrame:
    """train_size, train_mean, train_std, test_mean, test_std: for each share of the rows (or number, from 2 on) scores of models on folds of it."""
    n, rows = df.count(), []
    for size in sizes:
        taken = int(size) if size >= 2 else max(folds, int(n * size))
        dealt = kfold(subsample(df, key, taken, seed), key, folds, seed).persist()
        try:
            train, test = [], []
            for i in range(folds):
                model = make().fit(dealt.where(F.col("fold") != i))
                train.append(score(model.transform(dealt.where(F.col("fold") != i)), label))
                test.append(score(model.transform(dealt.where(F.col("fold") == i)), label))
        finally:
            dealt.unpersist()
        rows.append((min(taken, n), Scores(train).mean, Scores(train).std, Scores(test).mean, Scores(test).std))
    return df.sparkSession.createDataFrame(rows, "train_size int, train_mean double, train_std double, test_mean double, test_std double")

"""Feature scores: one aggregate over all features, no p-values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _long(df: DataFrame, features: Sequence[str], *keep: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])
    return df.select(*keep, F.inline(cells))


def variances(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, variance (population)."""
    row = df.agg(*[F.var_pop(f).alias(f) for f in features])
    return row.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("variance")) for f in features])))


def f_classif(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """feature, f: between-class over within-class mean squares; 0 where either has no freedom or the latter is 0."""
    groups = _long(df, features, label).groupBy("feature", label).agg(F.count("x").alias("k"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    every = Window.partitionBy("feature")
    groups = groups.withColumn("g", F.sum(F.col("k") * F.col("m")).over(every) / F.sum("k").over(every))
    sums = groups.groupBy("feature").agg(F.sum(F.col("k") * (F.col("m") - F.col("g")) ** 2).alias("between"), F.sum(F.col("k") * F.col("v")).alias("within"), F.sum("k").alias("n"), F.count(F.lit(1)).alias("c"))
    score = F.when((F.col("n") > F.col("c")) & (F.col("within") > 0) & (F.col("c") > 1), (F.col("between") / F.nullif(F.col("c") - 1, F.lit(0))) / (F.nullif(F.col("within"), F.lit(0.0)) / F.nullif(F.col("n") - F.col("c"), F.lit(0))))
    return sums.select("feature", F.coalesce(score, F.lit(0.0)).alias("f"))


def f_regression(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """feature, f = r^2 (n - 2) / (1 - r^2)."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.try_divide(F.covar_pop(f, label), F.stddev_pop(f) * F.stddev_pop(label)).alias(f) for f in features])
    r2 = lambda f: F.col(f) * F.col(f)
    return row.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.when((r2(f) < 1) & (F.col("n") > 2), r2(f) * (F.col("n") - 2) / F.nullif(1 - r2(f), F.lit(0.0))).otherwise(0.0).alias("f")) for f in features])))


def chi2(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """feature, chi2 over sums of non-negative features by class; expected = feature sum * class sum / total."""
    if df.where(F.least(*[F.col(f) for f in features], F.lit(0)) < 0).limit(1).count():
        raise ValueError("chi2 takes features that aren't negative")
    sums = _long(df, features, label).groupBy("feature", label).agg(F.sum("x").alias("o"))
    by_feature, by_class, every = Window.partitionBy("feature"), Window.partitionBy(label), Window.partitionBy()
    cells = sums.withColumn("e", F.sum("o").over(by_feature) * F.sum("o").over(by_class) / F.sum("o").over(every))
    return cells.groupBy("feature").agg(F.sum(F.when(F.col("e") > 0, (F.col("o") - F.col("e")) ** 2 / F.nullif(F.col("e"), F.lit(0.0))).otherwise(0.0)).alias("chi2"))


def mutual_info(df: DataFrame, feature: str, label: str, bins: int = 10) -> DataFrame:
    """feature, mi in nats over equal-width bins."""
    low, high = df.agg(F.min(feature), F.max(feature)).first()
    width = (high - low) / bins
    width = 1.0 if width < 1e-10 else width
    bin_of = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(feature) - low) / width).cast("int")))
    cells = df.groupBy(F.col(label).alias("y"), bin_of.alias("b")).agg(F.count(F.lit(1)).alias("c"))
    n = F.sum("c").over(Window.partitionBy())
    part = (F.col("c") / n) * F.ln(F.col("c") * n / (F.sum("c").over(Window.partitionBy("y")) * F.sum("c").over(Window.partitionBy("b"))))
    return cells.select(part.alias("part")).agg(F.greatest(F.sum("part"), F.lit(0.0)).alias("mi")).select(F.lit(feature).alias("feature"), "mi")


def mutual_info_regression(df: DataFrame, feature: str, label: str, bins: int = 10) -> DataFrame:
    """feature, mi: the label too in equal-width bins."""
    low, high = df.agg(F.min(label), F.max(label)).first()
    width = (high - low) / bins if high is not None else 1.0
    width = 1.0 if width < 1e-10 else width
    binned = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(label) - low) / width).cast("int")))
    return mutual_info(df.select(feature, binned.alias("y_")), feature, "y_", bins)


SCORES = {"f_classif": f_classif, "f_regression": f_regression, "chi2": chi2}


def scores_of(df: DataFrame, features: Sequence[str], label: str, kind: str) -> DataFrame:
    """feature, score by name: f_classif, f_regression, chi2, mutual_info_classif or mutual_info_regression."""
    if kind in SCORES:
        return SCORES[kind](df, features, label).toDF("feature", "score")
    if kind not in ("mutual_info_classif", "mutual_info_regression"):
        raise ValueError(f"unknown score {kind}")
    one = mutual_info if kind.endswith("classif") else mutual_info_regression
    return reduce(DataFrame.unionByName, [one(df, f, label) for f in features]).toDF("feature", "score")


@dataclass
class SelectKBest:
    """Keeps the k best features, in their order, beside all other columns. k <= 0 or beyond their number keeps all."""

    features: Sequence[str]
    label: str
    kind: str = "f_classif"
    k: int = 10
    kept: list[str] = field(default_factory=list)
    scores: dict[str, float] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> SelectKBest:
        self.scores = {r[0]: r[1] for r in scores_of(df.dropna(subset=[*self.features, self.label]), self.features, self.label, self.kind).collect()}
        k = self.k if 0 < self.k < len(self.features) else len(self.features)
        best = sorted(self.features, key=lambda f: (-self.scores.get(f, 0.0), list(self.features).index(f)))[:k]
        self.kept = [f for f in self.features if f in best]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*[f for f in self.features if f not in self.kept])


@dataclass
class VarianceThreshold:
    """Keeps features whose population variance is above the threshold."""

    features: Sequence[str]
    threshold: float = 0.0
    kept: list[str] = field(default_factory=list)

    def fit(self, df: DataFrame) -> VarianceThreshold:
        found = {r[0]: r[1] for r in variances(df, self.features).collect()}
        self.kept = [f for f in self.features if found[f] is not None and found[f] > self.threshold]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*[f for f in self.features if f not in self.kept])


def select_k_best(scores: DataFrame, k: int) -> list[str]:
    """Names of the k best of a table feature, score (its second column); ties by name."""
    return [row[0] for row in scores.orderBy(F.desc(scores.columns[1]), "feature").limit(k).collect()]

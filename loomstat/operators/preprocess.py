"""Scalers, encoders and splits. Fitting is one aggregate; a fitted transformer is a projection."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16


@dataclass
class StandardScaler:
    """(x - mean) / population deviation; a deviation below machine epsilon counts as 1."""

    columns: Sequence[str]
    mean: list[float] = field(default_factory=list)
    std: list[float] = field(default_factory=list)

    def fit(self, df: DataFrame) -> StandardScaler:
        row = df.agg(*[F.avg(c) for c in self.columns], *[F.stddev_pop(c) for c in self.columns]).first()
        p = len(self.columns)
        self.mean, self.std = [0.0 if m is None else m for m in row[:p]], [s if s is not None and s >= EPSILON else 1.0 for s in row[p:]]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - m) / s for c, m, s in zip(self.columns, self.mean, self.std, strict=True)})

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * s + m for c, m, s in zip(self.columns, self.mean, self.std, strict=True)})


@dataclass
class MinMaxScaler:
    """(x - min) / (max - min); a constant column becomes 0."""

    columns: Sequence[str]
    low: list[float] = field(default_factory=list)
    high: list[float] = field(default_factory=list)

    def fit(self, df: DataFrame) -> MinMaxScaler:
        row = df.agg(*[F.min(c) for c in self.columns], *[F.max(c) for c in self.columns]).first()
        p = len(self.columns)
        # a column without values is left as it is
        self.low = [0.0 if lo is None else lo for lo in row[:p]]
        self.high = [lo + 1.0 if h is None or h - lo < EPSILON else h for lo, h in zip(self.low, row[p:], strict=True)]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - lo) / (h - lo) for c, lo, h in zip(self.columns, self.low, self.high, strict=True)})


@dataclass
class PolynomialFeatures:
    """[1], the features, then products of pairs; only degrees 1 and 2."""

    columns: Sequence[str]
    degree: int = 2
    include_bias: bool = True
    interaction_only: bool = False

    def __post_init__(self) -> None:
        if self.degree not in (1, 2):
            raise ValueError("only degrees 1 and 2 are defined")

    def expressions(self) -> list[Column]:
        out = [F.lit(1.0).alias("bias")] if self.include_bias else []
        out += [F.col(c) for c in self.columns]
        if self.degree == 2:
            pairs = itertools.combinations(self.columns, 2) if self.interaction_only else itertools.combinations_with_replacement(self.columns, 2)
            out += [(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs]
        return out

    def transform(self, df: DataFrame, *keep: str) -> DataFrame:
        return df.select(*keep, *self.expressions())


@dataclass
class OneHotEncoder:
    """Values truncated to integers; a column for each category, ascending; unknown values are all zero."""

    columns: Sequence[str]
    categories: dict[str, list[int]] = field(default_factory=dict)
    most: int = 10_000  # categories of a column; each becomes a column of the result

    def fit(self, df: DataFrame) -> OneHotEncoder:
        self.categories = {}
        for c in self.columns:
            found = df.select(F.col(c).cast("int").alias("v")).where("v IS NOT NULL").distinct().orderBy("v").limit(self.most + 1).collect()
            if len(found) > self.most:
                raise ValueError(f"{c} has more than {self.most} categories")
            self.categories[c] = [r[0] for r in found]
        return self

    def transform(self, df: DataFrame, *keep: str) -> DataFrame:
        return df.select(*keep, *[F.coalesce((F.col(c).cast("int") == v).cast("double"), F.lit(0.0)).alias(f"{c}_{v}") for c in self.columns for v in self.categories[c]])


PRIME, STEP, CELL, CELLS = 1000003, 2654435761 % 1000003, 1024, 4096


def spread(key: str, seed: int) -> Column:
    """Portable pseudo-random order of integer keys, (key * 2654435761 + seed) mod 1000003 without overflow; ties by the key, null keys first."""
    return F.pmod(F.pmod(F.col(key), F.lit(PRIME)) * F.lit(STEP) + F.lit(seed % PRIME), F.lit(PRIME))


def _in_order(key: str, seed: int | None) -> tuple[list[Column], Column]:
    """The order of rows by key, or shuffled, and a cell that rises with it."""
    by_key = F.col(key).asc_nulls_first()
    if seed is None:
        return [by_key], F.floor(F.col(key) / CELL)
    return [spread(key, seed).asc_nulls_first(), by_key], F.floor(spread(key, seed) / 1000)


def train_test_split(df: DataFrame, key: str, test_ratio: float, seed: int = 42) -> DataFrame:
    """Adds is_test, with exactly floor(n * ratio) test rows; rows with a null key come first in the order."""
    if not 0 < test_ratio < 1:
        raise ValueError("test_ratio must lie between 0 and 1")
    return numbered(df, *_in_order(key, seed)).withColumn("is_test", F.col("row_number") > F.col("rows") - F.floor(F.col("rows") * test_ratio)).drop("row_number", "rows")


def numbered(df: DataFrame, order: Sequence[Column], cell: Column, by: Sequence[str] = ()) -> DataFrame:
    """Adds row_number (from 1, in the order, within the groups of `by`) and rows (of the group). cell must rise with the order and is null where
    the order begins. Each cell is numbered by a task of its own; sums before cells run within stretches of CELLS cells, and over the stretches."""
    named = [F.col(c).alias(f"b{i}_") for i, c in enumerate(by)]
    groups, cell = [f"b{i}_" for i in range(len(by))], F.coalesce(cell.cast("long"), F.lit(-(1 << 62)))
    cells = df.groupBy(*named, cell.alias("cell_")).agg(F.count(F.lit(1)).alias("c_")).withColumn("wide_", F.floor(F.col("cell_") / CELLS))
    wide = cells.groupBy(*groups, "wide_").agg(F.sum("c_").alias("w_"))
    upto = Window.unboundedPreceding
    every = Window.partitionBy(*groups)
    wide = wide.select(*[F.col(g).alias(f"{g}w") for g in groups], F.col("wide_").alias("wide_w"), F.coalesce(F.sum("w_").over(every.orderBy("wide_").rowsBetween(upto, -1)), F.lit(0)).alias("far_"), F.sum("w_").over(every).alias("rows"))
    near = F.coalesce(F.sum("c_").over(Window.partitionBy(*groups, "wide_").orderBy("cell_").rowsBetween(upto, -1)), F.lit(0))
    same = [F.col(g).eqNullSafe(F.col(f"{g}w")) for g in groups] + [F.col("wide_") == F.col("wide_w")]
    cells = cells.withColumn("near_", near).join(wide, same).select(*groups, "cell_", (F.col("near_") + F.col("far_")).alias("before_"), "rows")
    out = df.withColumn("at_", cell).withColumn("r_", F.row_number().over(Window.partitionBy(*by, "at_").orderBy(*order)))
    out = out.join(cells, [F.col(c).eqNullSafe(F.col(g)) for c, g in zip(by, groups, strict=True)] + [F.col("at_") == F.col("cell_")])
    return out.withColumn("row_number", F.col("r_") + F.col("before_")).drop("cell_", "at_", "r_", "before_", *groups)


def kfold(df: DataFrame, key: str, folds: int, seed: int | None = None) -> DataFrame:
    """Adds fold: contiguous slices of the order by key (or shuffled by seed); the first n mod k folds hold one row more."""
    if folds < 2:
        raise ValueError("at least two folds")
    out = numbered(df, *_in_order(key, seed))
    at, n = F.col("row_number") - 1, F.col("rows")
    small, extra = F.floor(n / folds), n % folds
    fold = F.when(at < (small + 1) * extra, F.floor(at / (small + 1))).otherwise(extra + F.floor((at - (small + 1) * extra) / F.greatest(small, F.lit(1))))
    return out.withColumn("fold", fold.cast("int")).drop("row_number", "rows")


def stratified_kfold(df: DataFrame, key: str, label: str, folds: int, seed: int | None = None, contiguous: bool = False) -> DataFrame:
    """Adds fold: the rank within the class modulo the folds, or, contiguous, slices of the class; shuffled by seed."""
    out = numbered(df, *_in_order(key, seed), by=[label])
    at = F.col("row_number") - 1
    fold = F.floor(at * folds / F.col("rows")) if contiguous else F.pmod(at, F.lit(folds))
    return out.withColumn("fold", fold.cast("int")).drop("row_number", "rows")


def subsample(df: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """The first `size` rows of the shuffled order."""
    return numbered(df, *_in_order(key, seed)).where(F.col("row_number") <= size).drop("row_number", "rows")


def random_column(key: str, seed: int, low: float = 0.0, high: float = 1.0) -> Column:
    """Uniform in [low, high), from the key: the same at any partitioning."""
    return F.lit(low) + F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 52)) / float(1 << 52) * (high - low)


def random_normal(key: str, seed: int, mean: float = 0.0, std: float = 1.0) -> Column:
    """Box and Muller's transform of two uniform numbers."""
    radius = F.sqrt(-2 * F.log(1.0 - random_column(key, seed)))
    return F.lit(mean) + radius * F.cos(2 * math.pi * random_column(key, seed + 1)) * std


def add_bias(df: DataFrame, name: str = "bias") -> DataFrame:
    """A leading column of ones."""
    return df.select(F.lit(1.0).alias(name), "*")

"""Matrices and sample tables from expressions over spark.range. Matrices are triples row, col, value, or rows of columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def filled(spark: SparkSession, rows: int, cols: int, value: float = 0.0) -> DataFrame:
    """row, col, value."""
    return spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("row"), F.pmod("id", F.lit(cols)).alias("col"), F.lit(float(value)).alias("value"))


def identity(spark: SparkSession, n: int) -> DataFrame:
    return filled(spark, n, n).withColumn("value", (F.col("row") == F.col("col")).cast("double"))


def three_classes(spark: SparkSession, per_class: int = 50, seed: int = 42) -> DataFrame:
    """id, x0..x3, y: three classes of four features around (5.0, 3.4, 1.5, 0.2), (5.9, 2.8, 4.3, 1.3) and (6.6, 3.0, 5.6, 2.0)."""
    centres = [(5.0, 3.4, 1.5, 0.2), (5.9, 2.8, 4.3, 1.3), (6.6, 3.0, 5.6, 2.0)]
    y = F.floor(F.col("id") / per_class).cast("int")
    noise = lambda i: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i)), F.lit(1000)) / 1000.0 - 0.5) * 0.8
    features = [(F.element_at(F.array(*[F.lit(c[i]) for c in centres]), y + 1) + noise(i)).alias(f"x{i}") for i in range(4)]
    return spark.range(3 * per_class).select("id", *features, y.alias("y"))


def linear_table(spark: SparkSession, rows: int = 100, seed: int = 42) -> DataFrame:
    """id, x0, x1, x2, y = 3 x0 + 2 x1 - x2 + 5."""
    x = [(F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i)), F.lit(10_000)) / 1000.0).alias(f"x{i}") for i in range(3)]
    return spark.range(rows).select("id", *x).withColumn("y", 3 * F.col("x0") + 2 * F.col("x1") - F.col("x2") + 5)


def from_numpy(spark: SparkSession, values: np.ndarray, prefix: str = "x") -> DataFrame:
    """id and a column for each of the array's."""
    values = np.atleast_2d(np.asarray(values, float))
    return spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(values)], ", ".join(["id long", *[f"{prefix}{j} double" for j in range(values.shape[1])]]))


def to_numpy(df: DataFrame, columns: list[str], order: str = "id") -> np.ndarray:
    """All rows on the driver: for results of bounded size."""
    return df.orderBy(order).select(*columns).toPandas().to_numpy(float)

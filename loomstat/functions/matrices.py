"""Matrices as triples row, col, value: joins and sums, so that neither side is held by one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _paired(a: DataFrame, b: DataFrame, value) -> DataFrame:
    right = b.select(F.col("row").alias("r_"), F.col("col").alias("c_"), F.col("value").alias("v_"))
    return a.join(right, (F.col("row") == F.col("r_")) & (F.col("col") == F.col("c_"))).select("row", "col", value(F.col("value"), F.col("v_")).alias("value"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return _paired(a, b, lambda x, y: x + y)


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return _paired(a, b, lambda x, y: x - y)


def hadamard(a: DataFrame, b: DataFrame) -> DataFrame:
    return _paired(a, b, lambda x, y: x * y)


def scale(a: DataFrame, by: float) -> DataFrame:
    return a.withColumn("value", F.col("value") * F.lit(float(by)))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join on the inner index, then a sum with map-side partials."""
    right = b.select(F.col("row").alias("k_"), F.col("col").alias("c_"), F.col("value").alias("v_"))
    return a.join(right, F.col("col") == F.col("k_")).groupBy("row", F.col("c_").alias("col")).agg(F.sum(F.col("value") * F.col("v_")).alias("value"))


def matrix_vector(a: DataFrame, v: DataFrame) -> DataFrame:
    """row, value. v: triples of one column."""
    return product(a, v).select("row", "value")


def rows_of(a: DataFrame, indices: DataFrame) -> DataFrame:
    """The rows named by indices (position, row), in that order, repeats too."""
    return indices.select(F.col("position"), F.col("row").alias("r_")).join(a, F.col("r_") == F.col("row")).select(F.col("position").alias("row"), "col", "value")


def from_columns(df: DataFrame, row: str, columns: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(i).alias("col"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)])
    return df.select(F.col(row).alias("row"), F.inline(cells))

"""Scores of predictions as one aggregate each. Labels are truncated to integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0)))


def regression_scores(df: DataFrame, y: str, p: str) -> DataFrame:
    error = F.col(y) - F.col(p)
    mse, total = F.coalesce(F.avg(error * error), F.lit(0.0)), F.var_pop(y)
    return df.agg(mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.coalesce(F.avg(F.abs(error)), F.lit(0.0)).alias("mae"), F.when(total > 0, 1 - mse / total).otherwise(F.lit(0.0)).alias("r2"))


def binary_scores(df: DataFrame, y: str, p: str) -> DataFrame:
    a, b = F.col(y).cast("int"), F.col(p).cast("int")
    cells = df.agg(
        F.count_if((a == 1) & (b == 1)).alias("tp"), F.count_if((a == 0) & (b == 0)).alias("tn"), F.count_if((a == 0) & (b == 1)).alias("fp"), F.count_if((a == 1) & (b == 0)).alias("fn"),
        F.coalesce(F.avg((a == b).cast("double")), F.lit(0.0)).alias("accuracy"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return cells.select("*", _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    """Dense matrix in long form over classes 0 to the largest label; negative labels are left out."""
    pairs = df.select(F.col(y).cast("int").alias("actual"), F.col(p).cast("int").alias("predicted")).where("actual >= 0 AND predicted >= 0").groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    top = pairs.agg(F.max(F.greatest("actual", "predicted")).alias("top"))
    grid = top.select(F.explode(F.sequence(F.lit(0), "top")).alias("actual"), "top").select("actual", F.explode(F.sequence(F.lit(0), "top")).alias("predicted"))
    return grid.join(pairs, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def class_scores(df: DataFrame, y: str, p: str) -> DataFrame:
    """macro precision, recall and F1 over all classes, and F1 weighted by support."""
    cells = confusion(df, y, p)
    side = lambda c: cells.groupBy(F.col(c).alias("k")).agg(F.sum("n").alias(f"by_{c}"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias(f"tp_{c}"))
    both = side("actual").join(side("predicted"), "k").withColumn("precision", _ratio(F.col("tp_actual"), F.col("by_predicted"))).withColumn("recall", _ratio(F.col("tp_actual"), F.col("by_actual")))
    both = both.withColumn("f1", _ratio(2 * F.col("tp_actual"), F.col("by_actual") + F.col("by_predicted")))
    return both.agg(F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"), F.avg("f1").alias("f1_macro"), (F.sum(F.col("f1") * F.col("by_actual")) / F.sum("by_actual")).alias("f1_weighted"))

"""Small exact cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.functions import vectors as V
from loomstat.operators import linear, metrics, neighbours, preprocess, selection


def test_linreg_closed(spark):
    df = spark.createDataFrame([(float(x), 2.0 * x + 1) for x in range(1, 6)], "x double, y double")
    m = linear.LinearRegression(["x"], "y").fit(df)
    assert m.intercept == pytest.approx(1) and m.weights[0] == pytest.approx(2)


def test_ridge_shrinks_and_lasso_zeroes(spark):
    df = spark.createDataFrame([(float(x), float(x % 3), 2.0 * x) for x in range(20)], "x double, z double, y double")
    plain, ridge = linear.LinearRegression(["x", "z"], "y").fit(df), linear.Ridge(["x", "z"], "y", alpha=100.0).fit(df)
    assert np.linalg.norm(ridge.weights) < np.linalg.norm(plain.weights)
    assert linear.Lasso(["x", "z"], "y", alpha=1.0).fit(df).weights[1] == 0


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 0), (0, 1), (1, 1)], "y int, p int")
    row = metrics.binary_scores(df, "y", "p").first()
    assert (row.tp, row.tn, row.fp, row.fn) == (2, 2, 1, 1) and row.f1 == pytest.approx(2 / 3)
    multi = spark.createDataFrame(list(zip([0, 0, 0, 1, 1, 1, 2, 2, 2], [0, 0, 1, 1, 1, 2, 2, 2, 0], strict=True)), "y int, p int")
    assert metrics.class_scores(multi, "y", "p").first().precision_macro == pytest.approx(2 / 3)
    assert [r.n for r in metrics.confusion(multi, "y", "p").orderBy("actual", "predicted").collect()] == [2, 1, 0, 0, 2, 1, 1, 0, 2]


def test_metrics_of_nothing(spark):
    row = metrics.regression_scores(spark.createDataFrame([], "y double, p double"), "y", "p").first()
    assert (row.mse, row.r2) == (0.0, 0.0)


def test_knn_and_kmeans(spark):
    train = spark.createDataFrame([(1, [0.0, 0.0], 0), (2, [0.5, 0.5], 0), (3, [10.0, 10.0], 1), (4, [10.5, 10.5], 1)], "id long, vector array<double>, label int")
    query = spark.createDataFrame([(1, [0.1, 0.1]), (2, [9.9, 9.9])], "id long, vector array<double>")
    assert {r.id: r.prediction for r in neighbours.knn_predict(train, query, 1).collect()} == {1: 0, 2: 1}
    points = spark.createDataFrame([(i, [float(x)]) for i, x in enumerate([1, 20, 2, 3, 21, 22])], "id long, vector array<double>")
    assert sorted(neighbours.KMeans(2).fit(points).centres.ravel()) == [2.0, 21.0]


def test_softmax_regression_learns(spark):
    df = spark.createDataFrame([(float(i % 3 == 1), float(i % 3 == 2), i % 3) for i in range(30)], "a double, b double, y int")
    m = linear.SoftmaxRegression(["a", "b"], "y", 3, learning_rate=1.0, max_iter=15).fit(df)
    assert m.transform(df).where("prediction <> y").count() == 0


def test_scalers_and_encoder(spark):
    df = spark.createDataFrame([(1.0, 5.0, 0.0), (3.0, 5.0, 1.0)], "x double, c double, k double")
    assert [r.x for r in preprocess.StandardScaler(["x", "c"]).fit(df).transform(df).orderBy("x").collect()] == [-1.0, 1.0]
    assert [r.c for r in preprocess.MinMaxScaler(["c"]).fit(df).transform(df).collect()] == [0.0, 0.0]
    coder = preprocess.OneHotEncoder(["k"]).fit(df)
    assert tuple(coder.transform(spark.createDataFrame([(7.0,)], "k double")).first()) == (0.0, 0.0)


def test_chi2_and_k_best(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0), (0.0, 1.0, 1)], "a double, b double, y int")
    scores = selection.chi2(df, ["a", "b"], "y")
    assert {r.feature: r.chi2 for r in scores.collect()} == {"a": 1.0, "b": 1.0}
    assert selection.select_k_best(scores, 1) == ["a"]


def test_soft_threshold(spark):
    df = spark.createDataFrame([(3.0,), (-3.0,), (0.5,)], "x double")
    assert [r[0] for r in df.select(V.soft_threshold(F.col("x"), 1.0)).collect()] == [2.0, -2.0, 0.0]


def test_split_sizes(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    assert preprocess.train_test_split(df, "k", 0.2).where("is_test").count() == 2
    assert [r["count"] for r in preprocess.kfold(df, "k", 3).groupBy("fold").count().orderBy("fold").collect()] == [4, 3, 3]


def test_pca_of_a_line(spark):
    from loomstat.operators.decomposition import PCA

    df = spark.createDataFrame([(float(x), 2.0 * x) for x in range(10)], "a double, b double")
    model = PCA(["a", "b"]).fit(df)
    assert model.ratio[0] == pytest.approx(1) and model.components[0][1] == pytest.approx(2 / 5**0.5)
    assert model.transform(df).agg(F.avg("pc0")).first()[0] == pytest.approx(0, abs=1e-9)

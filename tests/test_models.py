"""Trees, boosting, gradient models, cross-validation, grids and pipelines on small tables."""

import pytest

from loomstat.operators import density, linear, margins, preprocess, trees, validation


@pytest.fixture(scope="module")
def blobs(spark):
    rows = [(i, float(i % 7) + 10 * c, float(i % 5) - 10 * c, c) for c in (0, 1, 2) for i in range(c * 20, c * 20 + 20)]
    return spark.createDataFrame([*rows, (98, None, 1.0, 1), (99, 1.0, 1.0, None)], "id long, a double, b double, y int").repartition(3).cache()


def test_tree_separates_classes_and_tells_its_rules(blobs):
    model = trees.DecisionTree(["a", "b"], "y").fit(blobs)
    assert validation.accuracy(model.transform(blobs.dropna()), "y") == 1.0
    assert [n.n for n in model.nodes if n.feature is None] and sum(n.n for n in model.nodes if n.feature is None) == 60
    assert model.text().startswith("if ")


def test_tree_ties_take_the_first_feature_and_the_lowest_class(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1), (1.0, 1.0, 0)], "a double, b double, y int")
    model = trees.DecisionTree(["a", "b"], "y").fit(df)
    assert (model.nodes[0].feature, model.nodes[0].threshold, model.nodes[0].value) == ("a", 0.5, 0.0)
    assert trees.DecisionTree(["a", "b"], "y", min_leaf=2).fit(df).nodes[0].feature is None


def test_tree_without_rows_predicts_null(spark):
    df = spark.createDataFrame([], "a double, y int")
    other = spark.createDataFrame([(1.0, 1)], "a double, y int")
    assert trees.DecisionTree(["a"], "y").fit(df).transform(other).first()["prediction"] is None


def test_regression_tree_and_boosting(spark):
    df = spark.createDataFrame([(float(i), 3.0 if i < 5 else 9.0) for i in range(10)], "x double, y double")
    tree = trees.DecisionTree(["x"], "y", "regression").fit(df)
    assert [(n.threshold, n.value) for n in tree.nodes if n.feature] == [(4.5, 6.0)]
    boosted = trees.GradientBoosting(["x"], "y", n_trees=3, learning_rate=0.5).fit(df)
    assert boosted.task == "regression"
    assert boosted.transform(df).where("x = 0").first()["prediction"] == pytest.approx(6 - 3 * (1 - 0.5**3))
    binary = spark.createDataFrame([(float(i), int(i >= 5)) for i in range(10)], "x double, y int")
    model = trees.GradientBoosting(["x"], "y", n_trees=2).fit(binary)
    assert model.task == "classification" and validation.accuracy(model.transform(binary), "y") == 1.0


def test_forest_votes_and_repeats(blobs):
    make = lambda: trees.RandomForest(["a", "b"], "y", "id", n_trees=3, max_depth=3).fit(blobs.dropna())
    first, second = make(), make()
    assert validation.accuracy(first.transform(blobs.dropna()), "y") > 0.9
    assert [t.nodes for t in first.trees] == [t.nodes for t in second.trees]


@pytest.mark.parametrize("loss", ["log", "hinge"])
def test_gradient_classifiers(spark, loss):
    df = spark.createDataFrame([(float(i - 10), int(i >= 10)) for i in range(20)], "x double, y int")
    model = margins.GradientLinear(["x"], "y", loss, learning_rate=0.1, max_iter=20).fit(df)
    assert validation.accuracy(model.transform(df), "y") >= 0.95


def test_linear_svc_and_no_rows(spark):
    df = spark.createDataFrame([(float(i) - 4.5, int(i >= 5)) for i in range(10)], "x double, y int")
    model = margins.LinearSVC(["x"], "y", max_iter=20).fit(df)
    assert validation.accuracy(model.transform(df), "y") == 1.0
    assert list(margins.LinearSVC(["x"], "y").fit(df.limit(0)).weights) == [0.0]


def test_cross_validation_grid_and_pipeline(spark):
    df = spark.createDataFrame([(i, float(i), 2.0 * i + 1) for i in range(20)], "id long, x double, y double")
    scores = validation.cross_val_score(lambda: linear.LinearRegression(["x"], "y"), df, "id", "y", 4, validation.r_squared)
    assert len(scores.folds) == 4 and scores.mean == pytest.approx(1.0) and scores.std == pytest.approx(0.0, abs=1e-9)
    assert list(validation.combinations({"a": [1, 2], "b": [3, 4]})) == [{"a": 1, "b": 3}, {"a": 1, "b": 4}, {"a": 2, "b": 3}, {"a": 2, "b": 4}]
    search = validation.GridSearch(lambda alpha: linear.Ridge(["x"], "y", alpha=alpha), {"alpha": [1000.0, 0.0]}, "id", "y", 4, validation.r_squared).fit(df)
    assert search.best == {"alpha": 0.0} and search.ranks() == [2, 1]
    pipe = validation.Pipeline([("scale", preprocess.StandardScaler(["x"])), ("line", linear.LinearRegression(["x"], "y"))]).fit(df)
    assert validation.r_squared(pipe.transform(df), "y") == pytest.approx(1.0)
    with pytest.raises(ValueError, match="needs a step"):
        validation.Pipeline([]).fit(df)


def test_dbscan_numbers_clusters_and_leaves_noise(spark):
    chain = [(i, 0.4 * i, 0.0) for i in range(12)]
    other = [(20 + i, 30.0 + 0.1 * i, 5.0) for i in range(4)]
    df = spark.createDataFrame([*chain, *other, (50, -80.0, 9.0), (51, None, 1.0)], "id long, x double, y double").repartition(3)
    got = {r.id: (r.cluster, r.core) for r in density.dbscan(df, ["x", "y"], 0.5, 3).collect()}
    assert {got[i][0] for i in range(12)} == {0} and {got[20 + i][0] for i in range(4)} == {1}
    assert got[0] == (0, False) and got[50] == (-1, False) and 51 not in got
    assert density.dbscan(df.limit(0), ["x", "y"]).count() == 0


def test_squared_silhouette(spark):
    rows = [(0.0, 0.0, 0), (0.5, 0.5, 0), (-0.5, -0.5, 0), (5.0, 5.0, 1), (5.5, 5.5, 1), (4.5, 4.5, 1)]
    df = spark.createDataFrame(rows, "x double, y double, cluster int")

    def point(i):
        d = lambda j: (rows[i][0] - rows[j][0]) ** 2 + (rows[i][1] - rows[j][1]) ** 2
        a = sum(d(j) for j in range(6) if rows[j][2] == rows[i][2]) / 2
        b = sum(d(j) for j in range(6) if rows[j][2] != rows[i][2]) / 3
        return (b - a) / max(a, b)

    assert density.squared_silhouette(df, ["x", "y"]) == pytest.approx(sum(map(point, range(6))) / 6)
    assert density.squared_silhouette(df.where("cluster = 0"), ["x", "y"]) == 0.0

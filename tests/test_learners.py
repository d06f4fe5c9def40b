"""Networks, kernels, clusterings, forests, selection, storage, CSV and streams on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.__main__ import main
from loomstat.functions import matrices
from loomstat.operators import counts, grouping, kernels, linear, margins, neighbours, neural, preprocess, selection, trees, validation
from loomstat.operators.estimator import NotFittedError, TrainingHistory
from loomstat.sources import csvio, generators
from loomstat.sources.models import load_model
from loomstat.streaming.scoring import scored_stream, write_scores


@pytest.fixture(scope="module")
def ring(spark):
    """Class 1 around class 0: not linearly separable."""
    rng = random.Random(2)
    rows = []
    for i in range(160):
        y, turn = i % 2, rng.random() * 2 * math.pi
        r = 2.0 + rng.random() if y else rng.random()
        rows.append((i, r * math.cos(turn), r * math.sin(turn), y))
    return spark.createDataFrame([*rows, (900, None, 1.0, 1), (901, 1.0, 1.0, None)], "id long, a double, b double, y int").repartition(3).cache()


def test_network_learns_what_lines_cannot(ring):
    history, seen = TrainingHistory(), []
    model = neural.MLP(["a", "b"], "y", hidden=(8,), epochs=40, learning_rate=0.05).fit(ring, history, lambda *x: seen.append(x))
    assert model.score(ring.dropna()) > 0.95 and len(history.rows) == len(seen) == 40 and history.rows[-1][1] < history.rows[0][1]
    x = np.array([[0.3, -0.2], [2.0, 1.0]])
    got = model.transform(ring.sparkSession.createDataFrame(x.tolist(), "a double, b double")).collect()
    z = np.maximum(x @ model.layers[0][0].T + model.layers[0][1], 0) @ model.layers[1][0].T + model.layers[1][1]
    assert np.allclose([r.probabilities for r in got], 1 / (1 + np.exp(-z)))


def test_network_gradient_is_that_of_its_loss():
    model = neural.MLP(["a", "b"], "y", hidden=(3,), hidden_activation="tanh", classes=[0, 1, 2])
    model._start(3)
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(5, 2)), np.eye(3)[[0, 1, 2, 1, 0]]
    grad, flat = model._gradient(x, y)[1:], np.concatenate([v.ravel() for layer in model.layers for v in layer])
    for i in (0, 4, 8, 12, len(flat) - 1):
        sides = []
        for step in (1e-6, -1e-6):
            moved = flat.copy()
            moved[i] += step
            model._take(moved)
            sides.append(model._gradient(x, y)[0])
        model._take(flat)
        assert grad[i] == pytest.approx((sides[0] - sides[1]) / 2e-6, rel=1e-4, abs=1e-6)


def test_convolution_and_pooling(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2, 2, 5, 5))
    conv = neural.Conv2D(rng.normal(size=(3, 2, 3, 3)), rng.normal(size=3), stride=2, padding=1)
    y = conv.forward(x)
    wide = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
    assert y.shape == (2, 3, 3, 3) and y[1, 2, 1, 2] == pytest.approx((wide[1, :, 2:5, 4:7] * conv.weights[2]).sum() + conv.bias[2])
    up = rng.normal(size=y.shape)
    dx, dw, db = conv.backward(x, up)
    moved = x.copy()
    moved[0, 1, 2, 3] += 1e-6
    assert dx[0, 1, 2, 3] == pytest.approx(((conv.forward(moved) - y) * up).sum() / 1e-6, rel=1e-4)
    assert db == pytest.approx(up.sum(axis=(0, 2, 3))) and dw.shape == conv.weights.shape
    pool = neural.MaxPool2D(2, 2)
    assert pool.forward(x)[0, 0, 1, 0] == x[0, 0, 2:4, 0:2].max()
    back = pool.backward(x, np.ones((2, 2, 2, 2)))
    assert back.sum() == 16 and set(np.unique(back)) == {0.0, 1.0}
    net = neural.CNN((1, 4, 4)).conv(np.ones((1, 1, 3, 3)), [0.0]).relu().pool().flatten().dense([[1.0], [-1.0]], [0.0, 0.5]).softmax()
    df = spark.createDataFrame([(1, [1.0] * 16), (2, None), (3, [1.0])], "id long, vector array<double>")
    got = {r.id: r.outputs for r in net.transform(df).collect()}
    assert got[1] == pytest.approx([1 / (1 + math.exp(-8.5 - 9.0 + 0.0)), 1 / (1 + math.exp(17.5))]) and got[2] is None and got[3] is None


def test_kernel_classifier(ring):
    model = kernels.SVMClassifier(["a", "b"], "y", gamma=1.0).fit(ring)
    assert model.score(ring.dropna()) > 0.97
    assert kernels.SVMClassifier(["a", "b"], "y", kernel="linear").fit(ring).score(ring.dropna()) < 0.8
    with pytest.raises(ValueError, match="at most"):
        kernels.SVMClassifier(["a", "b"], "y", most=10).fit(ring)


def test_agglomerative(spark):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate([0, 1, 10, 11, 12, 30])], "id long, x double")
    for linkage in ("single", "complete", "average"):
        assert [r.cluster for r in grouping.agglomerative(df, ["x"], 3, linkage).orderBy("id").collect()] == [0, 0, 1, 1, 1, 2]
    chain = spark.createDataFrame([(i, float(x)) for i, x in enumerate([0, 2, 4, 6, 9])], "id long, x double")
    assert [r.cluster for r in grouping.agglomerative(chain, ["x"], 2, "single").orderBy("id").collect()] == [0, 0, 0, 0, 1]
    assert grouping.agglomerative(df, ["x"], 9).select("cluster").distinct().count() == 6


def test_isolation_forest_marks_the_outlier(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(300)] + [(999, 9.0, -9.0), (1000, None, 0.0)], "id long, a double, b double")
    model = grouping.IsolationForest(["a", "b"], n_trees=50, max_samples=64).fit(df)
    got = {r.id: r for r in model.transform(df).collect()}
    assert got[999].prediction == -1 and got[999].score == max(r.score for r in got.values() if r.score is not None) and got[1000].score is None
    assert sum(r.prediction == -1 for r in got.values()) <= 0.07 * len(got)
    assert all(t[0].shape == t[1].shape for t in model.trees)


def test_silhouette_is_exact(spark):
    points = {0: ([0.0, 0.0], 0), 1: ([1.0, 0.0], 0), 2: ([5.0, 5.0], 1), 3: ([6.0, 5.0], 1), 4: ([9.0, 0.0], 2)}
    df = spark.createDataFrame([(i, v, k) for i, (v, k) in points.items()], "id long, vector array<double>, cluster int")
    got = {r.id: r.silhouette for r in grouping.silhouette(df, block_bytes=100).collect()}
    dist = lambda i, j: math.dist(points[i][0], points[j][0])
    for i, (_, k) in points.items():
        own = [dist(i, j) for j, (_, c) in points.items() if c == k and j != i]
        b = min(sum(dist(i, j) for j, (_, c) in points.items() if c == o) / sum(c == o for _, c in points.values()) for o in {0, 1, 2} - {k})
        a = sum(own) / len(own) if own else None
        assert got[i] == pytest.approx(0.0 if a is None else (b - a) / max(a, b))


def test_binned_trees_are_the_exact_ones(ring):
    exact = trees.DecisionTree(["a", "b"], "y", max_depth=4).fit(ring)
    bins = trees.DecisionTree(["a", "b"], "y", max_depth=4, bins=500).fit(ring)
    assert [(n.feature, n.n, n.value) for n in exact.nodes] == [(n.feature, n.n, n.value) for n in bins.nodes]
    assert [n.threshold for n in exact.nodes] == pytest.approx([n.threshold for n in bins.nodes])
    got = exact.transform(ring.dropna()).select(exact.probabilities().alias("p"), "prediction").collect()
    assert all(r.p[r.prediction] == max(r.p) and sum(r.p) == pytest.approx(1) for r in got)


def test_forest_votes_and_out_of_bag(ring):
    model = trees.RandomForest(["a", "b"], "y", "id", n_trees=5, max_depth=5, bins=64).fit(ring)
    assert model.score(ring.dropna()) > 0.9 and 0.7 < model.oob_score(ring.dropna()) <= 1
    assert all(sum(r.probabilities) == pytest.approx(1) for r in model.transform(ring.dropna()).collect())
    assert all(len(t.features) == 1 for t in trees.RandomForest(["a", "b"], "y", "id", n_trees=2, max_depth=1, max_features=1).fit(ring).trees)


def test_boosting_with_many_rounds(ring):
    model = trees.GradientBoosting(["a", "b"], "y", n_trees=12, learning_rate=0.3, max_depth=2, subsample=0.8).fit(ring)
    assert model.score(ring.dropna()) > 0.9 and len(model.trees) == 12


def test_moments_use_complete_rows(spark):
    rows = [(float(i), 2.0 * i + (0.1 if i % 2 else -0.1)) for i in range(20)]
    df = spark.createDataFrame([*rows, (50.0, None), (None, 3.0)], "x double, y double")
    for kind in (linear.LinearRegression, linear.Ridge, linear.Lasso):
        whole, dropped = kind(["x"], "y").fit(df), kind(["x"], "y").fit(df.dropna())
        assert whole.weights == pytest.approx(dropped.weights) and whole.intercept == pytest.approx(dropped.intercept)
    both = df.dropna().withColumn("z", 3 * F.col("x"))
    with pytest.raises(ValueError, match="dependent"):
        linear.LinearRegression(["x", "z"], "y").fit(both)
    tiny = df.dropna().select((F.col("x") * 1e-160).alias("x"), "y")
    assert linear.LinearRegression(["x"], "y").fit(tiny).weights[0] * 1e-160 == pytest.approx(2.0, abs=0.1)
    with pytest.raises(ValueError, match="complete"):
        linear.LinearRegression(["x"], "y").fit(df.limit(0))
    wide = spark.createDataFrame(np.random.default_rng(0).normal(size=(60, 30)).tolist(), ", ".join(f"c{i} double" for i in range(30)))
    n, mean, cov = linear.moments(wide, wide.columns)
    x = np.array(wide.collect(), float)
    assert n == 60 and np.allclose(mean, x.mean(axis=0)) and np.allclose(cov, np.cov(x.T, bias=True))


def test_splits_keep_null_and_large_keys(spark):
    df = spark.createDataFrame([(k, k and k % 2) for k in [None, 1, 2, 3, 4_000_000_000, 2**62, None]], "k long, y long")
    assert preprocess.train_test_split(df, "k", 0.3).groupBy("is_test").count().orderBy("is_test").collect() == [(False, 5), (True, 2)]
    for seed in (None, 5):
        assert sorted(r["count"] for r in preprocess.kfold(df, "k", 3, seed).groupBy("fold").count().collect()) == [2, 2, 3]
    assert preprocess.stratified_kfold(df, "k", "y", 2).count() == 7 and preprocess.stratified_kfold(df, "k", "y", 2, 3, True).count() == 7
    assert preprocess.subsample(df, "k", 4).count() == 4
    assert preprocess.MinMaxScaler(["k"]).fit(df.limit(0)).transform(df).count() == 7


def test_probabilities(spark, ring):
    nb = neighbours.GaussianNB(["a", "b"], "y").fit(ring)
    assert all(sum(r.probabilities) == pytest.approx(1) for r in nb.transform(ring.dropna()).collect())
    mnb = counts.MultinomialNB(["u", "v"], "y").fit(spark.createDataFrame([(3, 0, 0), (0, 2, 1), (1, 1, 1)], "u int, v int, y int"))
    row = mnb.transform(spark.createDataFrame([(2, 0)], "u int, v int")).first()
    odds = math.exp(mnb.priors[1] + 2 * mnb.weights[1][0] - mnb.priors[0] - 2 * mnb.weights[0][0])
    assert row.prediction == 0 and row.probabilities == pytest.approx([1 / (1 + odds), odds / (1 + odds)])


def test_selectors(ring):
    noisy = ring.dropna().withColumn("flat", F.lit(1.0)).withColumn("good", F.col("y") * 3.0 + F.col("a") * 0.01)
    names = ["a", "b", "flat", "good"]
    for kind in ("f_classif", "f_regression", "mutual_info_classif", "mutual_info_regression"):
        assert selection.SelectKBest(names, "y", kind, 1).fit(noisy).kept == ["good"]
    assert selection.SelectKBest(names, "y", k=0).fit(noisy).kept == names
    assert "flat" not in selection.VarianceThreshold(names).fit(noisy).transform(noisy).columns
    with pytest.raises(ValueError):
        selection.chi2(noisy, ["a"], "y")


def test_leave_one_out_and_learning_curve(spark):
    df = generators.linear_table(spark, 24).withColumn("y", F.col("y") + F.sin("id"))
    make = lambda: linear.LinearRegression(["x0"], "y")
    errors = {r.id: r.loo_error for r in validation.leave_one_out_errors(df, ["x0"], "y").collect()}
    fit = make().fit(df.where("id <> 3"))
    left = df.where("id = 3").first()
    assert errors[3] == pytest.approx(left.y - fit.intercept - fit.weights[0] * left.x0)
    curve = validation.learning_curve(make, df, "id", "y", (0.5, 1.0), 3, validation.r_squared).collect()
    assert [r.train_size for r in curve] == [12, 24]
    assert len(validation.leave_one_out(make, df.limit(4), "id", "y", validation.r_squared).folds) == 4


@pytest.mark.parametrize("make", [
    lambda: linear.LinearRegression(["a", "b"], "y"), lambda: linear.Ridge(["a", "b"], "y"), lambda: margins.GradientLinear(["a", "b"], "y", loss="log", max_iter=3), lambda: margins.LinearSVC(["a", "b"], "y", max_iter=3),
    lambda: neighbours.GaussianNB(["a", "b"], "y"), lambda: trees.DecisionTree(["a", "b"], "y", max_depth=2), lambda: trees.GradientBoosting(["a", "b"], "y", n_trees=2, max_depth=1),
    lambda: kernels.SVMClassifier(["a", "b"], "y"), lambda: neural.MLP(["a", "b"], "y", hidden=(3,), epochs=2), lambda: grouping.IsolationForest(["a", "b"], n_trees=3),
    lambda: validation.Pipeline([("scale", preprocess.StandardScaler(["a", "b"])), ("model", linear.Ridge(["a", "b"], "y"))]),
])
def test_models_are_saved_cloned_and_score_streams(spark, ring, make, tmp_path):
    model, rows = make(), ring.dropna()
    assert not model.fitted()
    model.fit(rows)
    assert model.fitted() and not model.clone().fitted()
    with pytest.raises(NotFittedError):
        model.clone().score(rows)
    model.save(spark, f"file://{tmp_path}/model")
    again = load_model(spark, f"file://{tmp_path}/model")
    scores = lambda df: sorted((r.id, r.prediction) for r in df.collect())
    expected = scores(model.transform(rows))
    assert scores(again.transform(rows)) == expected
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    write_scores(again, stream, f"{tmp_path}/out", f"{tmp_path}/state", available_now=True).awaitTermination(120)
    assert scores(spark.read.parquet(f"{tmp_path}/out")) == expected
    with pytest.raises(ValueError):
        scored_stream(model, rows)


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('﻿# a comment\n// another\n\nx; y ;"z;1"\n1;2.5xyz;"3"\n\n 4 ;;6;7\n8\n')
    where = f"file://{path}"
    assert csvio.detect_delimiter(spark, where) == ";" and csvio.headers(spark, where)[0] == "x"
    plain = tmp_path / "b.csv"
    plain.write_text('x;y;"z;1"\n1;2.5xyz;"3"\n\n 4 ;;6;7\n8\n// no data\n# none\n')
    df = csvio.read_csv(spark, f"file://{plain}", csvio.CsvOptions(has_header=True, delimiter=None, missing=-1.0))
    assert df.columns == ["x", "y", "z;1"] and [tuple(r) for r in df.collect()] == [(1.0, 2.5, 3.0), (4.0, -1.0, 6.0), (8.0, -1.0, -1.0)]
    assert csvio.read_csv(spark, f"file://{plain}", csvio.CsvOptions(True, ";", max_rows=1, max_cols=2)).columns == ["x", "y"]
    strict = tmp_path / "c.csv"
    strict.write_text("1,2\n3,4\n")
    assert [tuple(r) for r in csvio.read_csv_strict(spark, f"file://{strict}").collect()] == [(1.0, 2.0), (3.0, 4.0)]
    strict.write_text("1,2\n3,x\n")
    with pytest.raises(Exception, match="no number"):
        csvio.read_csv_strict(spark, f"file://{strict}").collect()
    csvio.write_csv(df, f"file://{tmp_path}/out")
    assert sorted(map(tuple, csvio.read_csv(spark, f"file://{tmp_path}/out").collect()))[0] == (1.0, 2.5, 3.0)
    csvio.write_predictions(spark.createDataFrame([(2.0,), (2.5,)], "prediction double"), f"file://{tmp_path}/p")
    assert sorted(r[0] for r in spark.read.csv(f"file://{tmp_path}/p", header=True).collect()) == ["2", "2.500000"]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "d.csv").write_text("a,b,y\n" + "\n".join(f"{i},{i % 3},{2 * i + 1}" for i in range(30)) + "\n")
    data = f"file://{tmp_path}/d.csv"
    assert main(["train", "--model", "linreg", "--data", data, "--header", "--saved", f"file://{tmp_path}/m"]) == 0
    assert "score: 1.000000" in capsys.readouterr().out
    assert main(["predict", "--data", data, "--header", "--saved", f"file://{tmp_path}/m", "--out", f"file://{tmp_path}/o"]) == 0
    assert spark.read.csv(f"file://{tmp_path}/o", header=True).count() == 30
    assert main(["info", "--saved", f"file://{tmp_path}/m"]) == 0 and "LinearRegression" in capsys.readouterr().out


def test_matrices(spark):
    a = np.array([[1.0, 2.0, 0.0], [0.0, -1.0, 4.0]])
    triples = lambda m: spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(m) for j, v in enumerate(r)], "row long, col long, value double")
    dense = lambda df, shape: np.array([[{(r.row, r.col): r.value for r in df.collect()}[i, j] for j in range(shape[1])] for i in range(shape[0])])
    assert np.allclose(dense(matrices.product(triples(a), matrices.transpose(triples(a))), (2, 2)), a @ a.T)
    assert np.allclose(dense(matrices.subtract(triples(a), matrices.scale(triples(a), 2)), a.shape), -a)
    assert np.allclose(dense(matrices.product(triples(a), generators.identity(spark, 3)), a.shape), a)
    picked = matrices.rows_of(triples(a), spark.createDataFrame([(0, 1), (1, 1)], "position long, row long"))
    assert np.allclose(dense(picked, a.shape), a[[1, 1]])

"""Queries of matrices, learners and validation that go through the library's own functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.functions import matrices
from loomstat.functions import vectors as V
from loomstat.operators import counts, decomposition, density, grouping, kernels, linear, margins, neighbours, neural, preprocess, selection, trees, validation
from loomstat.plans.catalogue import CATALOGUE, FEATURES, ITEM, VECTORS, items, query, r, vectors
from loomstat.session import scratch_path, table
from loomstat.sources import csvio, generators
from loomstat.sources.models import load_model

PART = "(SELECT p_partkey AS id, p_size / 10.0::DOUBLE AS a, p_retailprice / 1000.0::DOUBLE AS b FROM part)"


def part(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / F.lit(10.0)).alias("a"), (F.col("p_retailprice") / F.lit(1000.0)).alias("b"))


@query("matrix_matmul", f"SELECT row, col, round(value, 4) AS value FROM (SELECT 0 AS row, 0 AS col, sum(a*a) AS value FROM {PART} UNION ALL SELECT 0, 1, sum(a*b) FROM {PART} UNION ALL SELECT 1, 0, sum(a*b) FROM {PART} UNION ALL SELECT 1, 1, sum(b*b) FROM {PART})")
def _(spark, d):
    a = matrices.from_columns(part(spark, d), "id", ["a", "b"])
    return matrices.product(matrices.transpose(a), a).select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.round("value", 4).alias("value"))


@query("matrix_sub", f"SELECT id AS row, 0 AS col, round(a - 2 * a, 6) + 0.0::DOUBLE AS value FROM {PART} UNION ALL SELECT id, 1, round(b - 2 * b, 6) + 0.0::DOUBLE FROM {PART}")
def _(spark, d):
    a = matrices.from_columns(part(spark, d), "id", ["a", "b"])
    return matrices.subtract(a, matrices.scale(a, 2.0)).select("row", "col", r(F.col("value")).alias("value"))


@query("matrix_identity", "SELECT a.range AS row, b.range AS col, CASE WHEN a.range = b.range THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM range(7) a, range(7) b")
def _(spark, d):
    return generators.identity(spark, 7)


@query("matrix_vector", f"SELECT id, round(2 * a - b, 6) + 0.0::DOUBLE AS u, round(a + b, 6) AS v FROM {PART}")
def _(spark, d):
    product = V.matrix_vector([[2.0, -1.0], [1.0, 1.0]], F.array("a", "b"))
    return part(spark, d).select("id", product.alias("p")).select("id", r(F.col("p")[0]).alias("u"), F.round(F.col("p")[1], 6).alias("v"))


FIRST = f"(SELECT arg_min(vector, id) AS f FROM {VECTORS})"


@query("euclidean_and_rbf", f"SELECT id, round(list_distance(vector, f), 6) AS distance, round(exp(-0.1::DOUBLE * list_distance(vector, f) ** 2), 6) AS rbf FROM {VECTORS}, {FIRST}")
def _(spark, d):
    v = vectors(spark, d)
    first = v.agg(F.min_by("vector", "id").alias("f"))  # one row
    return v.crossJoin(F.broadcast(first)).select("id", F.round(V.distance(F.col("vector"), F.col("f")), 6).alias("distance"), F.round(V.rbf(F.col("vector"), F.col("f"), 0.1), 6).alias("rbf"))


@query("activation_derivatives", f"SELECT id, round(s * (1 - s), 6) AS sigmoid, round(1 - tanh(x) ** 2, 6) + 0.0::DOUBLE AS tanh, CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS relu FROM (SELECT id, a - 2.5::DOUBLE AS x, 1 / (1 + exp(-(a - 2.5::DOUBLE))) AS s FROM {PART})")
def _(spark, d):
    x = F.col("a") - 2.5
    return part(spark, d).select("id", F.round(V.activation_derivative(x, "sigmoid"), 6).alias("sigmoid"), r(V.activation_derivative(x, "tanh")).alias("tanh"), V.activation_derivative(x, "relu").alias("relu"))


@query("add_bias", f"SELECT 1.0::DOUBLE AS bias, id, a, b FROM {PART}")
def _(spark, d):
    return preprocess.add_bias(part(spark, d))


@query("csv_roundtrip", "SELECT round(a, 6) AS c0, round(b, 6) AS c1 FROM " + PART)
def _(spark, d):
    path = scratch_path(spark, "csv")
    csvio.write_csv(part(spark, d).select("a", "b"), path)
    return csvio.read_csv(spark, path)


@query("model_save_load", CATALOGUE.oracle()["linreg_predict"])
def _(spark, d):
    x, path = items(spark, d), scratch_path(spark, "model")
    linear.LinearRegression(["l_quantity"], "l_extendedprice").fit(x).save(spark, path)
    return load_model(spark, path).transform(x).select("l_quantity", F.round("prediction", 3).alias("prediction"))


NB = f"""WITH i AS {ITEM}, s AS (SELECT y AS c, ln(count(*) / (SELECT count(*) FROM i)::DOUBLE) AS p, {", ".join(f"avg({f}) AS m{k}, var_pop({f}) + 1e-9::DOUBLE AS v{k}" for k, f in enumerate(FEATURES))} FROM i GROUP BY y),
g AS (SELECT l_quantity, l_discount, l_tax, y, c, p {" ".join(f"- 0.5::DOUBLE * ln(2 * pi() * v{k}) - ({f} - m{k}) ** 2 / (2 * v{k})" for k, f in enumerate(FEATURES))} AS z FROM (SELECT DISTINCT * EXCLUDE (l_extendedprice) FROM i) i, s)"""


@query("gaussian_nb_predict", NB + ", b AS (SELECT l_quantity, l_discount, l_tax, y, arg_max(c, (z, -c)) AS prediction FROM g GROUP BY ALL) SELECT y, prediction, count(*) AS n FROM b GROUP BY ALL")
def _(spark, d):
    x = items(spark, d)
    model = neighbours.GaussianNB(FEATURES, "y").fit(x)
    return model.transform(x.select(*FEATURES, "y").distinct()).groupBy("y", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query("gaussian_nb_proba", NB + ", t AS (SELECT *, z - max(z) OVER w AS e FROM g WINDOW w AS (PARTITION BY l_quantity, l_discount, l_tax, y)), q AS (SELECT y, c, exp(e) / sum(exp(e)) OVER (PARTITION BY l_quantity, l_discount, l_tax, y) AS p FROM t) SELECT y, c, round(avg(p), 6) AS p FROM q GROUP BY y, c")
def _(spark, d):
    x = items(spark, d)
    model = neighbours.GaussianNB(FEATURES, "y").fit(x)
    scored = model.transform(x.select(*FEATURES, "y").distinct())
    return scored.select("y", F.posexplode("probabilities").alias("c", "p")).groupBy("y", "c").agg(F.round(F.avg("p"), 6).alias("p"))


def lloyd(rounds: int, k: int) -> str:
    out = f"WITH p AS {PART}, c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS i, a, b FROM p ORDER BY id LIMIT {k})"
    near = "SELECT p.id, p.a, p.b, arg_min(c.i, ((p.a - c.a) ** 2 + (p.b - c.b) ** 2, c.i)) AS i FROM p, c{t} c GROUP BY ALL"
    for t in range(rounds):
        out += f", a{t} AS ({near.format(t=t)}), c{t + 1} AS (SELECT c.i, coalesce(m.a, c.a) AS a, coalesce(m.b, c.b) AS b FROM c{t} c LEFT JOIN (SELECT i, avg(a) AS a, avg(b) AS b FROM a{t} GROUP BY i) m ON m.i = c.i)"
    return out + f" SELECT CAST(i AS INTEGER) AS cluster, count(*) AS n, round(avg(a), 6) AS a, round(avg(b), 6) AS b FROM ({near.format(t=rounds)}) GROUP BY i"


@query("kmeans_lloyd", lloyd(4, 3))
def _(spark, d):
    x = part(spark, d).withColumn("vector", F.array("a", "b"))
    model = neighbours.KMeans(3, max_iter=4).fit(x)
    return model.transform(x).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("a"), 6).alias("a"), F.round(F.avg("b"), 6).alias("b"))


@query("silhouette", f"WITH v AS {VECTORS}, m AS (SELECT x.id, x.label AS k, y.label AS o, avg(list_distance(x.vector, y.vector)) AS d FROM v x, v y WHERE x.id <> y.id GROUP BY ALL), s AS (SELECT id, max(d) FILTER (o = k) AS a, min(d) FILTER (o <> k) AS b FROM m GROUP BY id) SELECT id, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END, 6) + 0.0::DOUBLE AS silhouette FROM s")
def _(spark, d):
    return grouping.silhouette(vectors(spark, d), "label").select("id", r(F.col("silhouette")).alias("silhouette"))


FOLDS = "SELECT o_custkey::DOUBLE AS x, o_totalprice AS y, CASE WHEN i < (n // 3 + 1) * (n % 3) THEN i // (n // 3 + 1) ELSE n % 3 + (i - (n // 3 + 1) * (n % 3)) // (n // 3) END AS fold FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)"


@query("cv_linreg", f"WITH f AS ({FOLDS}), m AS (SELECT k.range AS k, regr_slope(y, x) AS s, regr_intercept(y, x) AS c FROM f, range(3) k WHERE fold <> k.range GROUP BY k.range) SELECT CAST(k AS INTEGER) AS fold, round(1 - avg((y - c - s * x) ** 2) / var_pop(y), 6) + 0.0::DOUBLE AS score FROM f JOIN m ON f.fold = m.k GROUP BY k")
def _(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("x"), F.col("o_totalprice").alias("y"))
    scores = validation.cross_val_score(lambda: linear.LinearRegression(["x"], "y"), x, "o_orderkey", "y", 3, validation.r_squared)
    return spark.createDataFrame([(i, float(round(s, 6)) + 0.0) for i, s in enumerate(scores.folds)], "fold int, score double")


@query("leave_one_out_linreg", f"WITH p AS {PART}, m AS (SELECT regr_slope(b, a) AS s, regr_intercept(b, a) AS c, avg(a) AS ma, sum((a - (SELECT avg(a) FROM p)) ** 2) AS sa, count(*) AS n FROM p) SELECT id, round((b - c - s * a) / (1 - 1 / n - (a - ma) ** 2 / sa), 6) + 0.0::DOUBLE AS loo_error FROM p, m")
def _(spark, d):
    return validation.leave_one_out_errors(part(spark, d), ["a"], "b").select("id", r(F.col("loo_error")).alias("loo_error"))


@query("mlp_forward_fixed", f"SELECT id, round(1 / (1 + exp(-(0.5::DOUBLE * h0 - 0.25::DOUBLE * h1 + 0.1::DOUBLE))), 6) AS p0, round(1 / (1 + exp(-(-0.5::DOUBLE * h0 + h1))), 6) AS p1 FROM (SELECT id, greatest(0.3::DOUBLE * a - 0.2::DOUBLE * b + 0.05::DOUBLE, 0) AS h0, greatest(-0.1::DOUBLE * a + 0.6::DOUBLE * b, 0) AS h1 FROM {PART})")
def _(spark, d):
    layers = [(np.array([[0.3, -0.2], [-0.1, 0.6]]), np.array([0.05, 0.0])), (np.array([[0.5, -0.25], [-0.5, 1.0]]), np.array([0.1, 0.0]))]
    model = neural.MLP(["a", "b"], "y", layers=layers, classes=[0, 1])
    return model.transform(part(spark, d)).select("id", F.round(F.col("probabilities")[0], 6).alias("p0"), F.round(F.col("probabilities")[1], 6).alias("p1"))


KERNEL = [[0.5, -1.0, 0.25], [1.0, 0.0, -0.5], [-0.25, 0.75, 1.0]]


def cells(terms: list[str]) -> str:
    return f"SELECT id, CAST(unnest(range({len(terms)})) AS INTEGER) AS at, round(unnest([{', '.join(terms)}]), 4) + 0.0::DOUBLE AS value FROM {VECTORS}"


def image(net: neural.CNN, spark, d) -> DataFrame:
    return net.transform(vectors(spark, d)).select("id", F.posexplode("outputs").alias("at", "value")).select("id", "at", r(F.col("value"), 4).alias("value"))


@query("conv2d_forward", cells([" + ".join(f"{KERNEL[i][j]}::DOUBLE * vector[{(y + i) * 8 + x + j + 1}]" for i in range(3) for j in range(3)) for y in range(6) for x in range(6)]))
def _(spark, d):
    return image(neural.CNN((1, 8, 8)).conv(np.array([[KERNEL]]), [0.0]).flatten(), spark, d)


@query("maxpool2d", cells([f"greatest({', '.join(f'vector[{(2 * y + i) * 8 + 2 * x + j + 1}]' for i in range(2) for j in range(2))})" for y in range(4) for x in range(4)]))
def _(spark, d):
    return image(neural.CNN((1, 8, 8)).pool(2, 2).flatten(), spark, d)


@query("im2col", cells([f"vector[{(y + i) * 8 + x + j + 1}]" for i in range(3) for j in range(3) for y in range(0, 6, 3) for x in range(0, 6, 3)]))
def _(spark, d):
    # a stride of three keeps the long table small: each of nine kernel places, then each position
    net = neural.CNN((1, 8, 8)).conv(np.eye(9).reshape(9, 1, 3, 3), np.zeros(9), stride=3).flatten()
    return image(net, spark, d)


@query("mutual_info_regression", f"""WITH i AS {ITEM}, e AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, min(l_extendedprice) AS lp, max(l_extendedprice) AS hp FROM i),
b AS (SELECT least(9, greatest(0, floor((l_quantity - lo) / ((hi - lo) / 10)))) AS x, least(9, greatest(0, floor((l_extendedprice - lp) / ((hp - lp) / 10)))) AS y FROM i, e),
c AS (SELECT x, y, count(*) AS c FROM b GROUP BY x, y)
SELECT 'l_quantity' AS feature, round(sum(c / n::DOUBLE * ln(c * n / (cx * cy)::DOUBLE)), 6) AS mi FROM (SELECT c, sum(c) OVER () AS n, sum(c) OVER (PARTITION BY x) AS cx, sum(c) OVER (PARTITION BY y) AS cy FROM c)""")
def _(spark, d):
    return selection.mutual_info_regression(items(spark, d), "l_quantity", "l_extendedprice").select("feature", F.round("mi", 6).alias("mi"))


# no SQL says these: tests hold them


def two_classes(spark, d) -> DataFrame:
    return part(spark, d).withColumn("y", (F.col("a") + F.col("b") > 4).cast("int"))


@query("decision_tree_predict")
def _(spark, d):
    x = items(spark, d)
    return trees.DecisionTree(FEATURES, "y", max_depth=4, bins=256).fit(x).transform(x).groupBy("y", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query("random_forest")
def _(spark, d):
    x = two_classes(spark, d)
    return trees.RandomForest(["a", "b"], "y", "id", n_trees=5, max_depth=4, bins=64).fit(x).transform(x).select("id", "prediction", "probabilities")


@query("gradient_boosting")
def _(spark, d):
    x = two_classes(spark, d)
    return trees.GradientBoosting(["a", "b"], "y", n_trees=10, bins=64).fit(x).transform(x).select("id", "probability", "prediction")


@query("isolation_forest_scores")
def _(spark, d):
    x = part(spark, d)
    return grouping.IsolationForest(["a", "b"]).fit(x).transform(x)


@query("svm_linear")
def _(spark, d):
    x = two_classes(spark, d)
    return kernels.SVMClassifier(["a", "b"], "y", kernel="linear", max_iter=20).fit(x).transform(x).select("id", "score", "prediction")


@query("svm_rbf")
def _(spark, d):
    x = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") / 10).alias("a"), (F.col("n_regionkey") > 2).cast("int").alias("y"))
    return kernels.SVMClassifier(["a"], "y", gamma=2.0).fit(x).transform(x).select("id", "score", "prediction")


@query("mlp_fit")
def _(spark, d):
    x = two_classes(spark, d)
    return neural.MLP(["a", "b"], "y", hidden=(4,), epochs=10).fit(x).transform(x).select("id", "prediction")


@query("agglomerative")
def _(spark, d):
    x = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("a"))
    return grouping.agglomerative(x, ["a"], 5)


@query("dbscan_labels")
def _(spark, d):
    x = part(spark, d)
    return density.dbscan(x, ["a", "b"], eps=0.05, min_samples=3)


@query("pca_transform")
def _(spark, d):
    x = part(spark, d)
    return decomposition.PCA(["a", "b"]).fit(x).transform(x)


@query("multinomial_nb_predict")
def _(spark, d):
    x = two_classes(spark, d)
    return counts.MultinomialNB(["a", "b"], "y").fit(x).transform(x).select("id", "prediction", "probabilities")


@query("softmax_gd")
def _(spark, d):
    x = two_classes(spark, d)
    return linear.SoftmaxRegression(["a", "b"], "y", 2, max_iter=10).fit(x).transform(x).select("id", "prediction", "probabilities")


@query("select_k_best")
def _(spark, d):
    x = items(spark, d)
    best = selection.SelectKBest(FEATURES, "y", k=1).fit(x)
    return spark.createDataFrame([(f, best.scores[f], f in best.kept) for f in FEATURES], "feature string, score double, kept boolean")


@query("pipeline_predict")
def _(spark, d):
    x = two_classes(spark, d)
    pipe = validation.Pipeline([("scale", preprocess.StandardScaler(["a", "b"])), ("model", margins.GradientLinear(["a", "b"], "y", loss="log", max_iter=10))])
    return pipe.fit(x).predict(x).select("id", "prediction")


@query("learning_curve")
def _(spark, d):
    return validation.learning_curve(lambda: linear.LinearRegression(["a"], "b"), part(spark, d), "id", "b", (0.5, 1.0), 3, validation.r_squared)


@query("grid_search_rank")
def _(spark, d):
    grid = validation.GridSearch(lambda **s: linear.Ridge(["a"], "b", **s), {"alpha": [0.1, 10.0]}, "id", "b", 3, validation.r_squared).fit(part(spark, d))
    return spark.createDataFrame([(s["alpha"], m.mean, k) for (s, m), k in zip(grid.results, grid.ranks(), strict=True)], "alpha double, score double, rank int")

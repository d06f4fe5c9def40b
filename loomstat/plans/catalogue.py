"""All queries of the core library, by name, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.functions import vectors as V
from loomstat.operators import counts, decomposition, density, linear, margins, metrics, neighbours, preprocess, selection, trees
from loomstat.registry import Catalogue
from loomstat.session import table

CATALOGUE = Catalogue()
query = CATALOGUE.query
SIX, FOUR = 6, 4
#: lineitem's numeric features and a class label from its return flag
FEATURES = ["l_quantity", "l_discount", "l_tax"]
FLAG = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"
ITEM = f"(SELECT l_quantity, l_extendedprice, l_discount, l_tax, {FLAG} AS y FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL AND l_extendedprice IS NOT NULL)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", F.expr(FLAG).alias("y")).dropna()


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"), F.col("label"))


VECTORS = "(SELECT vec_id AS id, embedding::DOUBLE[] AS vector, label FROM embeddings)"


def r(column, digits: int = SIX):
    return F.round(column, digits) + 0.0


@query("matrix_scale_add", "SELECT p_partkey, p_size * 2.0::DOUBLE + p_retailprice AS v, p_size * p_retailprice AS h FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", (F.col("p_size") * F.lit(2.0) + F.col("p_retailprice")).alias("v"), (F.col("p_size") * F.col("p_retailprice")).alias("h"))


@query(
    "matrix_gram",
    f"SELECT i, j, round(sum(v), 4) + 0.0::DOUBLE AS v FROM (SELECT unnest([0,0,0,1,1,2]) AS i, unnest([0,1,2,1,2,2]) AS j, unnest([l_quantity*l_quantity, l_quantity*l_discount, l_quantity*l_tax, l_discount*l_discount, l_discount*l_tax, l_tax*l_tax]) AS v FROM {ITEM}) GROUP BY i, j",
)
def _(spark, d):
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    row = items(spark, d).agg(*[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"s{i}{j}") for i, j in pairs])
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), r(F.col(f"s{i}{j}"), FOUR).alias("v")) for i, j in pairs])
    return row.select(F.inline(cells))


@query("vector_norm_dot", f"SELECT id, round(sqrt(list_dot_product(vector, vector)), 6) AS norm, round(list_sum(vector), 6) + 0.0::DOUBLE AS total FROM {VECTORS}")
def _(spark, d):
    v = F.col("vector")
    return vectors(spark, d).select("id", F.round(V.norm(v), 6).alias("norm"), r(F.aggregate(v, F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("activations", "SELECT p_partkey, round(1/(1+exp(-x)), 6) AS sigmoid, round(tanh(x), 6) + 0.0::DOUBLE AS tanh, greatest(x, 0) + 0.0::DOUBLE AS relu, CASE WHEN x > 0 THEN x ELSE 0.01::DOUBLE * x END AS leaky FROM (SELECT p_partkey, (p_size - 25) / 10.0::DOUBLE AS x FROM part)")
def _(spark, d):
    x = (F.col("p_size") - 25) / F.lit(10.0)
    return table(spark, d, "part").select("p_partkey", F.round(V.activation(x, "sigmoid"), 6).alias("sigmoid"), r(V.activation(x, "tanh")).alias("tanh"), (V.activation(x, "relu") + 0.0).alias("relu"), V.activation(x, "leaky_relu").alias("leaky"))


@query("softmax_rows", "SELECT p_partkey, round(exp(a-m)/(exp(a-m)+exp(b-m)), 6) AS p0, round(exp(b-m)/(exp(a-m)+exp(b-m)), 6) AS p1 FROM (SELECT *, greatest(a,b) AS m FROM (SELECT p_partkey, p_size / 10.0::DOUBLE AS a, p_retailprice / 1000 AS b FROM part))")
def _(spark, d):
    p = V.softmax([F.col("p_size") / F.lit(10.0), F.col("p_retailprice") / 1000])
    return table(spark, d, "part").select("p_partkey", F.round(p[0], 6).alias("p0"), F.round(p[1], 6).alias("p1"))


@query("mean_var_std", f"SELECT round(avg(l_extendedprice), 4) AS mean, round(var_samp(l_extendedprice), 2) AS variance, round(stddev_samp(l_extendedprice), 4) AS std, round(stddev_pop(l_extendedprice), 4) AS std_pop FROM {ITEM}")
def _(spark, d):
    x = "l_extendedprice"
    return items(spark, d).agg(F.round(F.avg(x), 4).alias("mean"), F.round(F.var_samp(x), 2).alias("variance"), F.round(F.stddev_samp(x), 4).alias("std"), F.round(F.stddev_pop(x), 4).alias("std_pop"))


@query("covariance_matrix", f"SELECT round(covar_samp(l_quantity, l_extendedprice), 4) AS qp, round(covar_samp(l_quantity, l_discount), 6) + 0.0::DOUBLE AS qd, round(corr(l_quantity, l_extendedprice), 6) AS corr_qp FROM {ITEM}")
def _(spark, d):
    return items(spark, d).agg(F.round(F.covar_samp("l_quantity", "l_extendedprice"), 4).alias("qp"), r(F.covar_samp("l_quantity", "l_discount")).alias("qd"), F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("corr_qp"))


@query("standardize", f"SELECT round((l_quantity - m) / s, 6) + 0.0::DOUBLE AS z FROM {ITEM}, (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM {ITEM})")
def _(spark, d):
    x = items(spark, d)
    return preprocess.StandardScaler(["l_quantity"]).fit(x).transform(x).select(r(F.col("l_quantity")).alias("z"))


@query("minmax_scale", "SELECT o_orderkey, round((o_totalprice - lo) / (hi - lo), 6) AS v FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)")
def _(spark, d):
    x = table(spark, d, "orders")
    return preprocess.MinMaxScaler(["o_totalprice"]).fit(x).transform(x).select("o_orderkey", F.round("o_totalprice", 6).alias("v"))


@query("polynomial_features", "SELECT p_partkey, 1.0::DOUBLE AS bias, a, b, a*a AS a_a, a*b AS a_b, b*b AS b_b FROM (SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice AS b FROM part)")
def _(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    return preprocess.PolynomialFeatures(["a", "b"]).transform(x, "p_partkey")


@query("onehot", "SELECT n_nationkey, " + ", ".join(f"CASE WHEN n_regionkey = {i} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS n_regionkey_{i}" for i in range(5)) + " FROM nation")
def _(spark, d):
    x = table(spark, d, "nation")
    return preprocess.OneHotEncoder(["n_regionkey"]).fit(x).transform(x, "n_nationkey")


@query("train_test_split", "SELECT o_orderkey, row_number() OVER (ORDER BY (o_orderkey * 2654435761 + 42) % 1000003, o_orderkey) > count(*) OVER () - CAST(floor(count(*) OVER () * 0.2) AS BIGINT) AS is_test FROM orders")
def _(spark, d):
    return preprocess.train_test_split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.2)


@query("kfold_assign", "SELECT o_orderkey, CAST(CASE WHEN i < (n // 7 + 1) * (n % 7) THEN i // (n // 7 + 1) ELSE n % 7 + (i - (n // 7 + 1) * (n % 7)) // (n // 7) END AS INTEGER) AS fold FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)")
def _(spark, d):
    return preprocess.kfold(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 7)


@query("stratified_kfold_assign", "SELECT event_id, event_type, CAST((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) % 5 AS INTEGER) AS fold FROM events")
def _(spark, d):
    return preprocess.stratified_kfold(table(spark, d, "events").select("event_id", "event_type"), "event_id", "event_type", 5)


@query("variance_threshold", f"SELECT f AS feature, round(v, 6) AS variance FROM (SELECT unnest(['l_quantity','l_discount','l_tax']) AS f, unnest([var_pop(l_quantity), var_pop(l_discount), var_pop(l_tax)]) AS v FROM {ITEM}) WHERE v > 0.0008::DOUBLE")
def _(spark, d):
    return selection.variances(items(spark, d), FEATURES).where("variance > 0.0008").select("feature", F.round("variance", 6).alias("variance"))


@query(
    "f_classif",
    "SELECT feature, round((ssb / (c - 1)) / (ssw / (n - c)), 6) AS f FROM (SELECT feature, sum(k * (m - g) * (m - g)) AS ssb, sum(k * v) AS ssw, sum(k) AS n, count(*) AS c FROM (SELECT feature, y, count(*) AS k, avg(x) AS m, var_pop(x) AS v, any_value(g) AS g FROM (SELECT *, avg(x) OVER (PARTITION BY feature) AS g FROM (SELECT y, unnest(['l_quantity','l_discount','l_tax']) AS feature, unnest([l_quantity, l_discount, l_tax]) AS x FROM "
    + ITEM
    + ")) GROUP BY feature, y) GROUP BY feature)",
)
def _(spark, d):
    return selection.f_classif(items(spark, d), FEATURES, "y").select("feature", F.round("f", 6).alias("f"))


@query("f_regression", f"SELECT feature, round(c * c * (n - 2) / (1 - c * c), 4) AS f FROM (SELECT unnest(['l_quantity','l_discount','l_tax']) AS feature, unnest([corr(l_quantity, l_extendedprice), corr(l_discount, l_extendedprice), corr(l_tax, l_extendedprice)]) AS c, count(*) AS n FROM {ITEM})")
def _(spark, d):
    return selection.f_regression(items(spark, d), FEATURES, "l_extendedprice").select("feature", F.round("f", 4).alias("f"))


@query(
    "mutual_info_classif",
    "WITH b AS (SELECT y, least(9, greatest(0, CAST(floor((l_quantity - lo) / ((hi - lo) / 10)) AS INTEGER))) AS bin FROM "
    + ITEM
    + ", (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM "
    + ITEM
    + ")), j AS (SELECT y, bin, count(*) AS c FROM b GROUP BY y, bin), t AS (SELECT *, sum(c) OVER (PARTITION BY y) AS cy, sum(c) OVER (PARTITION BY bin) AS cb, sum(c) OVER () AS n FROM j) SELECT 'l_quantity' AS feature, round(greatest(sum((c / n) * ln(c * n / (cy * cb))), 0), 6) + 0.0::DOUBLE AS mi FROM t",
)
def _(spark, d):
    return selection.mutual_info(items(spark, d), "l_quantity", "y").select("feature", r(F.col("mi")).alias("mi"))


LINE = f"SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM {ITEM}"


@query("linreg_closed_1d", f"SELECT round(s, 4) AS slope, round(i, 3) AS intercept FROM ({LINE})")
def _(spark, d):
    m = linear.LinearRegression(["l_quantity"], "l_extendedprice").fit(items(spark, d))
    return spark.createDataFrame([(float(m.weights[0]), m.intercept)], "slope double, intercept double").select(F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query("linreg_predict", f"SELECT l_quantity, round(i + s * l_quantity, 3) AS prediction FROM {ITEM}, ({LINE})")
def _(spark, d):
    x = items(spark, d)
    return linear.LinearRegression(["l_quantity"], "l_extendedprice").fit(x).transform(x).select("l_quantity", F.round("prediction", 3).alias("prediction"))


@query("pipeline_linreg", f"SELECT round(avg(e * e), 1) AS mse, round(avg(abs(e)), 3) AS mae, round(1 - avg(e * e) / var_pop(l_extendedprice), 6) AS r2 FROM (SELECT l_extendedprice, l_extendedprice - (i + s * l_quantity) AS e FROM {ITEM}, ({LINE}))")
def _(spark, d):
    x = preprocess.StandardScaler(["l_quantity"]).fit(items(spark, d)).transform(items(spark, d))
    scored = linear.LinearRegression(["l_quantity"], "l_extendedprice").fit(x).transform(x)
    return metrics.regression_scores(scored, "l_extendedprice", "prediction").select(F.round("mse", 1).alias("mse"), F.round("mae", 3).alias("mae"), F.round("r2", 6).alias("r2"))


@query("ridge_1d", f"SELECT round(n * cxy / (n * vx + 1), 4) AS slope FROM (SELECT count(*) AS n, covar_pop(l_extendedprice, l_quantity) AS cxy, var_pop(l_quantity) AS vx FROM {ITEM})")
def _(spark, d):
    m = linear.Ridge(["l_quantity"], "l_extendedprice").fit(items(spark, d))
    return spark.createDataFrame([(float(m.weights[0]),)], "slope double").select(F.round("slope", 4).alias("slope"))


@query("lasso_1d", f"SELECT round(sign(cxy) * greatest(abs(cxy) - 1, 0) / vx, 4) AS slope FROM (SELECT covar_pop(l_extendedprice, l_quantity) AS cxy, var_pop(l_quantity) AS vx FROM {ITEM})")
def _(spark, d):
    m = linear.Lasso(["l_quantity"], "l_extendedprice").fit(items(spark, d))
    return spark.createDataFrame([(float(m.weights[0]),)], "slope double").select(F.round("slope", 4).alias("slope"))


STEP = "SELECT {k} + 1 AS k, w - 0.1::DOUBLE * g AS w FROM (SELECT any_value(w) AS w, avg((1 / (1 + exp(-(w * x))) - t) * x) AS g FROM g{k}, data)"


@query(
    "logreg_gd",
    f"WITH data AS (SELECT l_quantity / 50 AS x, CASE WHEN y = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS t FROM {ITEM}), g0 AS (SELECT 0 AS k, 0.0::DOUBLE AS w), "
    + ", ".join(f"g{k + 1} AS ({STEP.format(k=k)})" for k in range(5))
    + " SELECT round(w, 6) AS w FROM g5",
)
def _(spark, d):
    x = items(spark, d).select((F.col("l_quantity") / 50).alias("x"), (F.col("y") == 1).cast("double").alias("t"))
    m = linear.LogisticRegression(["x"], "t", max_iter=5).fit(x)
    return spark.createDataFrame([(float(m.weights[0]),)], "w double").select(F.round("w", 6).alias("w"))


NB = "(SELECT c.*, ln(n / sum(n) OVER ()) AS prior FROM (SELECT event_type AS k, count(*) AS n, avg(value) AS m, var_pop(value) + 1e-9 AS v FROM events WHERE value IS NOT NULL GROUP BY event_type) c)"


@query("gaussian_nb_fit", f"SELECT k, round(m, 6) AS m, round(v, 4) AS v, round(prior, 6) AS prior FROM {NB}")
def _(spark, d):
    from pyspark.sql import Window

    x = table(spark, d, "events").where("value IS NOT NULL").groupBy(F.col("event_type").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), (F.var_pop("value") + 1e-9).alias("v"))
    return x.select("k", F.round("m", 6).alias("m"), F.round("v", 4).alias("v"), F.round(F.ln(F.col("n") / F.sum("n").over(Window.partitionBy())), 6).alias("prior"))


QUERIES = "(SELECT * FROM " + VECTORS + " WHERE id % 20 = 0)"
NEAR = f"SELECT q.id, t.label, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.vector, t.vector), t.id) AS r FROM {QUERIES} q, {VECTORS} t WHERE t.id % 20 <> 0"


@query("knn_predict", f"SELECT id, label AS prediction FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, label) AS p FROM ({NEAR}) WHERE r <= 5 GROUP BY id, label) WHERE p = 1")
def _(spark, d):
    x = vectors(spark, d)
    return neighbours.knn_predict(x.where("id % 20 <> 0"), x.where("id % 20 = 0"), 5)


@query("knn_proba", f"SELECT id, label, count(*) / 5 AS probability FROM ({NEAR}) WHERE r <= 5 GROUP BY id, label")
def _(spark, d):
    x = vectors(spark, d)
    return neighbours.knn_votes(x.where("id % 20 <> 0"), x.where("id % 20 = 0"), 5).select("id", "label", (F.col("votes") / 5).alias("probability"))


@query(
    "kmeans_assign",
    f"WITH v AS {VECTORS}, c AS (SELECT row_number() OVER (ORDER BY id) - 1 AS i, vector AS m FROM (SELECT * FROM v ORDER BY id LIMIT 3)), s AS (SELECT id, CAST(i AS INTEGER) AS cluster, row_number() OVER (PARTITION BY id ORDER BY list_distance(vector, m), i) AS r FROM v, c) SELECT id, cluster FROM s WHERE r = 1",
)
def _(spark, d):
    x = vectors(spark, d)
    model = neighbours.KMeans(3, max_iter=0).fit(x)
    return model.assign(x).select("id", "cluster")


PAIR = "(SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END AS p FROM orders)"
CELLS = f"(SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, avg(CASE WHEN y = p THEN 1.0::DOUBLE ELSE 0 END) AS accuracy FROM {PAIR})"


@query("binary_metrics", f"SELECT tp, tn, fp, fn, round(accuracy, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM {CELLS}")
def _(spark, d):
    x = table(spark, d, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_totalprice") > 150000).cast("int").alias("p"))
    x = x.select(F.coalesce("y", F.lit(0)).alias("y"), F.coalesce("p", F.lit(0)).alias("p"))
    return metrics.binary_scores(x, "y", "p").select("tp", "tn", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query(
    "confusion_multi",
    "WITH p AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS actual, CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS predicted FROM lineitem) SELECT a.i AS actual, b.i AS predicted, count(p.actual) AS n FROM (SELECT unnest([0, 1, 2]) AS i) a CROSS JOIN (SELECT unnest([0, 1, 2]) AS i) b LEFT JOIN p ON p.actual = a.i AND p.predicted = b.i GROUP BY a.i, b.i",
)
def _(spark, d):
    x = table(spark, d, "lineitem").select(F.expr(FLAG).alias("y"), F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("p"))
    return metrics.confusion(x, "y", "p")


@query("pca_explained_variance", "WITH c AS (SELECT covar_samp(a, a) AS aa, covar_samp(b, b) AS bb, covar_samp(a, b) AS ab FROM (SELECT l_quantity AS a, l_extendedprice / 1000 AS b FROM " + ITEM + ")), e AS (SELECT (aa + bb) / 2 AS m, sqrt((aa - bb) * (aa - bb) / 4 + ab * ab) AS h FROM c) SELECT round(m + h, 4) AS first, round(m - h, 4) AS second, round((m + h) / (2 * m), 6) AS ratio FROM e")
def _(spark, d):
    x = items(spark, d).select(F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"))
    model = decomposition.PCA(["a", "b"]).fit(x)
    row = (float(model.variance[0]), float(model.variance[1]), float(model.ratio[0]))
    return spark.createDataFrame([row], "first double, second double, ratio double").select(F.round("first", 4).alias("first"), F.round("second", 4).alias("second"), F.round("ratio", 6).alias("ratio"))


@query(
    "chi2",
    "WITH o AS (SELECT feature, y, sum(x) AS o FROM (SELECT y, unnest(['l_quantity','l_discount','l_tax']) AS feature, unnest([l_quantity, l_discount, l_tax]) AS x FROM "
    + ITEM
    + ") GROUP BY feature, y), e AS (SELECT *, sum(o) OVER (PARTITION BY feature) * sum(o) OVER (PARTITION BY y) / sum(o) OVER () AS e FROM o) SELECT feature, round(sum((o - e) * (o - e) / e), 6) AS chi2 FROM e GROUP BY feature",
)
def _(spark, d):
    return selection.chi2(items(spark, d), FEATURES, "y").select("feature", F.round("chi2", 6).alias("chi2"))


@query(
    "multinomial_nb_fit",
    "SELECT y, feature, round(ln((s + 1) / (sum(s) OVER (PARTITION BY y) + 3)), 6) AS theta FROM (SELECT y, unnest(['l_quantity','l_discount','l_tax']) AS feature, unnest([sum(l_quantity), sum(l_discount), sum(l_tax)]) AS s FROM " + ITEM + " GROUP BY y)",
)
def _(spark, d):
    m = counts.MultinomialNB(FEATURES, "y").fit(items(spark, d))
    rows = [(c, f, w) for c, ws in zip(m.classes, m.weights, strict=True) for f, w in zip(FEATURES, ws, strict=True)]
    return spark.createDataFrame(rows, "y int, feature string, theta double").select("y", "feature", F.round("theta", 6).alias("theta"))


CELL = f"SELECT y, l_extendedprice, f, CASE f WHEN 0 THEN l_quantity WHEN 1 THEN l_discount ELSE l_tax END AS x FROM (SELECT *, unnest([0, 1, 2]) AS f FROM {ITEM})"


@query(
    "decision_tree_stump",
    f"WITH c AS (SELECT f, x, count(*) AS n, count(*) FILTER (y = 0) AS a, count(*) FILTER (y = 1) AS b, count(*) FILTER (y = 2) AS c FROM ({CELL}) GROUP BY f, x), "
    "l AS (SELECT f, x, lead(x) OVER v AS nx, sum(n) OVER v AS ln, sum(a) OVER v AS la, sum(b) OVER v AS lb, sum(c) OVER v AS lc, sum(n) OVER g AS n, sum(a) OVER g AS a, sum(b) OVER g AS b, sum(c) OVER g AS c FROM c WINDOW v AS (PARTITION BY f ORDER BY x ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY f)), "
    "s AS (SELECT f, (x + nx) / 2 AS t, (1 - (a*a + b*b + c*c) / (n*n)::DOUBLE) - ln / n * (1 - (la*la + lb*lb + lc*lc) / (ln*ln)::DOUBLE) - (n - ln) / n * (1 - ((a-la)*(a-la) + (b-lb)*(b-lb) + (c-lc)*(c-lc)) / ((n-ln)*(n-ln))::DOUBLE) AS gain FROM l WHERE nx IS NOT NULL) "
    "SELECT CASE f WHEN 0 THEN 'l_quantity' WHEN 1 THEN 'l_discount' ELSE 'l_tax' END AS feature, round(t, 6) AS threshold FROM s ORDER BY round(gain, 12) DESC, f, t LIMIT 1",
)
def _(spark, d):
    root = trees.DecisionTree(FEATURES, "y", max_depth=1).fit(items(spark, d)).nodes[0]
    return spark.createDataFrame([(root.feature, root.threshold)], "feature string, threshold double").select("feature", F.round("threshold", 6).alias("threshold"))


@query(
    "regression_tree_stump",
    f"WITH c AS (SELECT f, x, count(*) AS n, sum(l_extendedprice) AS a, sum(l_extendedprice * l_extendedprice) AS b FROM ({CELL}) GROUP BY f, x), "
    "l AS (SELECT f, x, lead(x) OVER v AS nx, sum(n) OVER v AS ln, sum(a) OVER v AS la, sum(b) OVER v AS lb, sum(n) OVER g AS n, sum(a) OVER g AS a, sum(b) OVER g AS b FROM c WINDOW v AS (PARTITION BY f ORDER BY x ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY f)), "
    "s AS (SELECT f, (x + nx) / 2 AS t, la / ln AS lm, (a - la) / (n - ln) AS rm, la * la / ln + (a - la) * (a - la) / (n - ln) AS gain FROM l WHERE nx IS NOT NULL), "
    "w AS (SELECT * FROM s ORDER BY gain DESC, f, t LIMIT 1) "
    "SELECT l_quantity, round(CASE WHEN CASE f WHEN 0 THEN l_quantity WHEN 1 THEN l_discount ELSE l_tax END <= t THEN lm ELSE rm END, 3) AS prediction FROM w, " + ITEM,
)
def _(spark, d):
    x = items(spark, d)
    model = trees.DecisionTree(FEATURES, "l_extendedprice", "regression", max_depth=1).fit(x)
    return model.transform(x).select("l_quantity", F.round("prediction", 3).alias("prediction"))


DESCENT = "g{k} AS (SELECT w - {rate} * (g + 0.0001::DOUBLE * w) AS w, b - {rate} * h AS b FROM (SELECT any_value(w) AS w, any_value(b) AS b, avg(s * x) AS g, avg(s) AS h FROM (SELECT x, w, b, {slope} AS s FROM g{last}, data)))"


def descent(slope: str, label: str, steps: int = 4) -> str:
    parts = [DESCENT.format(k=k + 1, last=k, slope=slope, rate=f"(0.01::DOUBLE / (1 + 0.0001::DOUBLE * {k}))") for k in range(steps)]
    return f"WITH data AS (SELECT l_quantity / 50 AS x, {label} AS t FROM {ITEM}), g0 AS (SELECT 0.0::DOUBLE AS w, 0.0::DOUBLE AS b), {', '.join(parts)} SELECT round(w, 8) + 0.0::DOUBLE AS w, round(b, 8) + 0.0::DOUBLE AS b FROM g{steps}"


def descended(spark: SparkSession, d: str, loss: str, label) -> DataFrame:
    x = items(spark, d).select((F.col("l_quantity") / 50).alias("x"), label.alias("t"))
    m = margins.GradientLinear(["x"], "t", loss, max_iter=4, tol=0.0).fit(x)
    return spark.createDataFrame([(float(m.weights[0]), float(m.intercept))], "w double, b double").select(r(F.col("w"), 8).alias("w"), r(F.col("b"), 8).alias("b"))


@query("sgd_squared", descent("(w * x + b - t)", "l_extendedprice / 100000"))
def _(spark, d):
    return descended(spark, d, "squared", F.col("l_extendedprice") / 100000)


@query("sgd_log", descent("(1 / (1 + exp(-(w * x + b))) - t)", "CASE WHEN y = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"))
def _(spark, d):
    return descended(spark, d, "log", (F.col("y") == 1).cast("double"))


@query("sgd_hinge", descent("(CASE WHEN t * (w * x + b) < 1 THEN -t ELSE 0 END)", "CASE WHEN y = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"))
def _(spark, d):
    return descended(spark, d, "hinge", (F.col("y") == 1).cast("int"))


@query("sgd_huber", descent("(CASE WHEN abs(w * x + b - t) <= 1 THEN w * x + b - t ELSE sign(w * x + b - t) END)", "l_extendedprice / 10000"))
def _(spark, d):
    return descended(spark, d, "huber", F.col("l_extendedprice") / 10000)


@query(
    "dbscan_points",
    "WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), near AS (SELECT a.id AS a, b.id AS b FROM p a, p b WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.05::DOUBLE * 0.05::DOUBLE), c AS (SELECT a FROM near GROUP BY a HAVING count(*) >= 5) SELECT id, id IN (SELECT a FROM c) AS core, id NOT IN (SELECT near.a FROM near JOIN c ON near.b = c.a) AS noise FROM p",
)
def _(spark, d):
    x = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return density.dbscan(x, ["x", "y"], 0.05, 5).select("id", "core", (F.col("cluster") == -1).alias("noise"))

# registers further queries
from loomstat.plans import learners  # noqa: E402, F401

"""python -m loomstat train | predict | info | benchmark: models over numeric CSV files."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomstat.operators import counts, kernels, linear, margins, neural, neighbours, trees
from loomstat.session import local_session
from loomstat.sources.csvio import CsvOptions, read_csv, write_predictions
from loomstat.sources.generators import linear_table, three_classes
from loomstat.sources.models import load_model

MODELS = {
    "linreg": lambda f, y: linear.LinearRegression(f, y),
    "ridge": lambda f, y: linear.Ridge(f, y),
    "lasso": lambda f, y: linear.Lasso(f, y),
    "logreg": lambda f, y: margins.GradientLinear(f, y, loss="log", learning_rate=0.1, max_iter=200),
    "sgd": lambda f, y: margins.GradientLinear(f, y),
    "svm": lambda f, y: kernels.SVMClassifier(f, y, kernel="linear"),
    "svm_rbf": lambda f, y: kernels.SVMClassifier(f, y),
    "nb": lambda f, y: neighbours.GaussianNB(f, y),
    "mnb": lambda f, y: counts.MultinomialNB(f, y),
    "dtree": lambda f, y: trees.DecisionTree(f, y),
    "dtree_reg": lambda f, y: trees.DecisionTree(f, y, "regression"),
    "gb": lambda f, y: trees.GradientBoosting(f, y),
    "nn": lambda f, y: neural.MLP(f, y),
}


def _table(spark: SparkSession, path: str, args: argparse.Namespace):
    return read_csv(spark, path, CsvOptions(has_header=args.header, delimiter=None))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomstat")
    parser.add_argument("command", choices=["train", "predict", "info", "benchmark"])
    parser.add_argument("--model", default="linreg", choices=sorted(MODELS))
    parser.add_argument("--data")
    parser.add_argument("--saved", help="folder of the model")
    parser.add_argument("--out", help="folder of the predictions")
    parser.add_argument("--target", help="label column; the last by default")
    parser.add_argument("--header", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    if args.command == "train":
        df = _table(spark, args.data, args)
        target = args.target or df.columns[-1]
        model = MODELS[args.model]([c for c in df.columns if c != target], target).fit(df)
        print(f"score: {model.score(df):.6f}")
        if args.saved:
            model.save(spark, args.saved)
    elif args.command == "predict":
        model = load_model(spark, args.saved)
        write_predictions(model.transform(_table(spark, args.data, args)), args.out)
    elif args.command == "info":
        model = load_model(spark, args.saved)
        print(type(model).__name__, *[f"{k}: {v}" for k, v in vars(model).items()], sep="\n  ")
    else:
        for name, df, features in (("classes", three_classes(spark), ["x0", "x1", "x2", "x3"]), ("linear", linear_table(spark), ["x0", "x1", "x2"])):
            for kind in ("nb", "dtree") if name == "classes" else ("linreg", "ridge"):
                at = time.perf_counter()
                model = MODELS[kind](features, "y").fit(df.withColumn("y", F.col("y")))
                print(f"{name} {kind}: score {model.score(df):.4f}, {time.perf_counter() - at:.2f} s")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

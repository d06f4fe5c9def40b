"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from loomstat.plans.catalogue import CATALOGUE
from loomstat.session import local_session

HEADLINE = ["pipeline_linreg", "linreg_predict", "standardize", "matrix_gram", "f_classif", "mutual_info_classif", "logreg_gd", "gaussian_nb_fit", "knn_predict", "kmeans_assign", "train_test_split", "kfold_assign", "confusion_multi", "decision_tree_stump", "regression_tree_stump", "sgd_log", "decision_tree_predict", "random_forest", "gradient_boosting", "kmeans_lloyd", "dbscan_labels", "mlp_fit", "conv2d_forward", "isolation_forest_scores"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    builders, seconds = CATALOGUE.builders(), {}
    builders[HEADLINE[0]](spark, folder).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        began = time.perf_counter()
        builders[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    scale = float(os.path.basename(folder.rstrip("/")).removeprefix("sf") or 0)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()

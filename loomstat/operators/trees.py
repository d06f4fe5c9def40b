"""Exact decision trees, grown level by level, and gradient boosting on them.

A level is one job: rows are routed to their node by a column expression, counted by (node, feature, value) with map-side
partial sums, and running sums over the values of a node and feature, range by range, give every midpoint's gain. Only the best split of
each node comes to the driver, so what is collected is bounded by the number of nodes, not of rows."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstat.operators.estimator import Estimator
from loomstat.session import checkpointed

PURE = 1e-10
CELLS, KEEP = 512, 10


@dataclass
class Node:
    value: float
    n: int
    feature: str | None = None
    threshold: float = 0.0
    left: int = -1
    right: int = -1
    shares: list[float] = field(default_factory=list)  # of the classes


def cuts_of(rows: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Of each feature the thresholds of its bins: all midpoints where it has at most `bins` values, else quantiles."""
    out = []
    for f in features:
        values = [r[0] for r in rows.select(f).where(F.col(f).isNotNull()).distinct().orderBy(f).limit(bins + 1).collect()]
        if len(values) <= bins:
            out.append([(a + b) / 2 for a, b in zip(values, values[1:], strict=False)])
        else:
            found = rows.agg(F.percentile_approx(f, [i / bins for i in range(1, bins)], 20_000)).first()[0]
            top = rows.agg(F.max(f)).first()[0]
            out.append(sorted({x for x in found if x < top}))
    return out


def binned(rows: DataFrame, features: Sequence[str], cuts: Sequence[Sequence[float]]) -> DataFrame:
    """Adds bins_, an array with the bin of each feature: the number of thresholds below its value."""
    edges = [np.array(c, float) for c in cuts]

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            # one column comes bare
            columns = (columns,) if isinstance(columns, pd.Series) else columns
            found = np.column_stack([np.searchsorted(e, c.to_numpy(float), side="left") for e, c in zip(edges, columns, strict=True)])
            yield pd.Series(list(found.astype(np.int32)))

    return rows.withColumn("bins_", run(*[F.col(f) for f in features]))


@dataclass
class DecisionTree(Estimator):
    """Splits `feature <= threshold` at midpoints of neighbouring values; ties to the first feature, then the lowest threshold.

    A node stays a leaf at max_depth, under min_split rows, when pure, or when its best split has a side under min_leaf rows or
    gains less than min_gain. Classes are integers, a leaf's tie goes to the lowest; a regression leaf is its mean. Rows with a null
    feature or label aren't used; at scoring a null goes right.

    bins: thresholds come from at most so many bins of a feature (exact where it has no more values); a level is then one aggregate of
    (node, feature, bin), whose sums, bounded by the bins, come to the driver."""

    learned = ("nodes", "bounds", "classes")

    features: Sequence[str]
    label: str
    task: str = "classification"
    criterion: str = "gini"
    max_depth: int = 10
    min_split: int = 2
    min_leaf: int = 1
    min_gain: float = 0.0
    bins: int | None = None
    nodes: list[Node] = field(default_factory=list)
    bounds: list[tuple[float, float]] = field(default_factory=list, repr=False)
    classes: list[int] = field(default_factory=list)

    def _sums(self, classes: Sequence[int]) -> dict[str, Column]:
        y = F.col("y_")
        if self.task == "regression":
            return {"n_": F.count(F.lit(1)), "a0_": F.sum(y), "a1_": F.sum(y * y)}
        return {"n_": F.count(F.lit(1))} | {f"a{i}_": F.sum((y == c).cast("double")) for i, c in enumerate(classes)}

    def _impurity(self, n: Column, sums: Sequence[Column]) -> Column:
        if self.task == "regression":
            return F.greatest(sums[1] / n - (sums[0] / n) * (sums[0] / n), F.lit(0.0))
        shares = [s / n for s in sums]
        if self.criterion == "entropy":
            return sum((F.when(p > 0, -p * F.log2(p)).otherwise(0.0) for p in shares), F.lit(0.0))
        return F.lit(1.0) - sum((p * p for p in shares), F.lit(0.0))

    def fit(self, df: DataFrame, cuts: Sequence[Sequence[float]] | None = None) -> DecisionTree:
        """cuts: thresholds of rows that have bins_ already."""
        given = ["bins_"] if cuts is not None else []
        rows = df.select(*[F.col(f).cast("double").alias(f) for f in self.features], F.col(self.label).cast("double" if self.task == "regression" else "int").alias("y_"), *given).dropna()
        if self.bins and cuts is None:
            cuts = cuts_of(rows, self.features, self.bins)
            rows = binned(rows, self.features, cuts).persist()
        classes = [] if self.task == "regression" else [r[0] for r in rows.select("y_").distinct().orderBy("y_").collect()]
        self.classes = classes
        parts = 2 if self.task == "regression" else len(classes)
        names = [f"a{i}_" for i in range(parts)]
        top = rows.agg(*[c.alias(n) for n, c in self._sums(classes).items()], *[F.struct(F.min(f), F.max(f)).alias(f"r{i}_") for i, f in enumerate(self.features)]).first()
        self.nodes, self.bounds = [self._leaf(top, classes, names)], [tuple(top[f"r{i}_"]) for i in range(len(self.features))] if top["n_"] else []
        open_nodes = [0] if self._splittable(rows, classes) else []
        for _ in range(self.max_depth):
            if not open_nodes:
                break
            best = self._best(rows, open_nodes, classes, names) if cuts is None else self._best_of_bins(rows, open_nodes, classes, names)
            open_nodes = [child for split in best for child in self._grow(split, classes, names)]
        if self.bins and not given:
            rows.unpersist()
        return self

    def _impurities(self, n: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """sums: a column for each of the sums."""
        if self.task == "regression":
            return np.maximum(sums[:, 1] / n - (sums[:, 0] / n) ** 2, 0.0)
        p = sums / n[:, None]
        if self.criterion == "entropy":
            return -(p * np.log2(np.where(p > 0, p, 1.0))).sum(axis=1)
        return 1.0 - (p * p).sum(axis=1)

    def _best_of_bins(self, rows: DataFrame, open_nodes: Sequence[int], classes: Sequence[int], names: Sequence[str]) -> list[dict]:
        cells = F.arrays_zip(F.col("bins_").alias("b_"), F.array(*[F.col(f) for f in self.features]).alias("x_"))
        at = rows.select(self.node().alias("node_"), "y_", F.posexplode(cells).alias("f_", "cell_")).where(F.col("node_").isin(list(open_nodes)))
        at = at.select("node_", "y_", "f_", "cell_.b_", "cell_.x_")
        ends = [F.min("x_").alias("first_"), F.max("x_").alias("last_")]
        table = at.groupBy("node_", "f_", "b_").agg(*[c.alias(n) for n, c in self._sums(classes).items()], *ends).toPandas().sort_values(["node_", "f_", "b_"])
        best: dict[int, dict] = {}
        columns = ["n_", *names]
        for (node, f), part in table.groupby(["node_", "f_"], sort=True):
            sums = part[columns].to_numpy(float)
            if len(part) < 2:
                continue
            left = np.cumsum(sums, axis=0)[:-1]
            total, right = sums.sum(axis=0), sums.sum(axis=0) - left
            whole = self._impurities(total[:1], total[None, 1:])[0]
            if whole < PURE:
                continue
            li, ri = self._impurities(left[:, 0], left[:, 1:]), self._impurities(right[:, 0], right[:, 1:])
            gain = np.round(whole - left[:, 0] / total[0] * li - right[:, 0] / total[0] * ri, 12)
            i = int(gain.argmax())
            if node in best and gain[i] <= best[node]["gain_"]:
                continue
            split = float(part["last_"].iloc[i] + part["first_"].iloc[i + 1]) / 2
            found = {"node_": int(node), "gain_": float(gain[i]), "f_": int(f), "split_": split, "li_": float(li[i]), "ri_": float(ri[i])}
            for side, values in (("l", left[i]), ("r", right[i])):
                found |= {f"{side}{c}": float(v) for c, v in zip(columns, values, strict=True)}
            best[node] = found
        return [best[n] for n in sorted(best)]

    def _splittable(self, rows: DataFrame, classes: Sequence[int]) -> bool:
        return self.nodes[0].n >= self.min_split and (self.task == "regression" or len(classes) > 1)

    def _leaf(self, sums, classes: Sequence[int], names: Sequence[str]) -> Node:
        n = sums["n_"]
        if not n:
            return Node(math.nan, 0)
        if self.task == "regression":
            return Node(sums["a0_"] / n, n)
        best = max(range(len(classes)), key=lambda i: (sums[names[i]], -i))
        return Node(float(classes[best]), n, shares=[sums[name] / n for name in names])

    def _best(self, rows: DataFrame, open_nodes: Sequence[int], classes: Sequence[int], names: Sequence[str]) -> list:
        """The best split of each open node: node, feature index, threshold, left and right sums."""
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("f_"), F.col(f).alias("x_")) for i, f in enumerate(self.features)])).alias("cell_")
        at = rows.select(self.node().alias("node_"), "y_", cells).where(F.col("node_").isin(list(open_nodes))).select("node_", "y_", "cell_.*")
        counts = at.groupBy("node_", "f_", "x_").agg(*[c.alias(n) for n, c in self._sums(classes).items()])
        left = self._running(counts, ["n_", *names])
        sides = left.where("next_ IS NOT NULL").select("*", *[(F.col(f"t{c}") - F.col(f"l{c}")).alias(f"r{c}") for c in ["n_", *names]])
        impurity = {s: self._impurity(F.col(f"{s}n_"), [F.col(f"{s}{c}") for c in names]) for s in "tlr"}
        gain = impurity["t"] - F.col("ln_") / F.col("tn_") * impurity["l"] - F.col("rn_") / F.col("tn_") * impurity["r"]
        scored = sides.select("*", F.round(gain, 12).alias("gain_"), impurity["t"].alias("at_"), impurity["l"].alias("li_"), impurity["r"].alias("ri_"), ((F.col("x_") + F.col("next_")) / 2).alias("split_"))
        rank = F.struct("gain_", (-F.col("f_")).alias("f"), (-F.col("split_")).alias("s"))
        kept = ["gain_", "f_", "split_", "at_", "li_", "ri_", "ln_", "rn_", *[f"{s}{c}" for s in "lr" for c in names]]
        return scored.where(F.col("at_") >= PURE).groupBy("node_").agg(F.max_by(F.struct(*kept), rank).alias("b")).select("node_", "b.*").orderBy("node_").collect()

    def _running(self, counts: DataFrame, columns: Sequence[str]) -> DataFrame:
        """next_, running sums l* and totals t* over the values of each node and feature.

        The values are dealt into CELLS ranges of their feature; a task runs over one range, and the sums before a range come from
        a table of at most CELLS rows for each node and feature, so a feature with many values isn't in one task."""
        bounds = self.bounds
        cell = F.lit(0)
        for i, (low, high) in enumerate(bounds):
            if high > low:
                cell = F.when(F.col("f_") == i, F.floor((F.col("x_") - low) / (high - low) * (CELLS - 1)).cast("int")).otherwise(cell)
        counts = counts.withColumn("c_", cell)
        group, after = Window.partitionBy("node_", "f_"), Window.partitionBy("node_", "f_").orderBy("c_")
        cells = counts.groupBy("node_", "f_", "c_").agg(F.min("x_").alias("first_"), *[F.sum(c).alias(c) for c in columns])
        before = after.rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.select("node_", "f_", "c_", F.lead("first_").over(after).alias("beyond_"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"b{c}") for c in columns], *[F.sum(c).over(group).alias(f"t{c}") for c in columns])
        inside = Window.partitionBy("node_", "f_", "c_").orderBy("x_")
        upto = inside.rowsBetween(Window.unboundedPreceding, 0)
        own = counts.select("node_", "f_", "c_", "x_", F.lead("x_").over(inside).alias("near_"), *[F.sum(c).over(upto).alias(f"w{c}") for c in columns])
        return own.join(cells, ["node_", "f_", "c_"]).select("node_", "f_", "x_", F.coalesce("near_", "beyond_").alias("next_"), *[(F.col(f"b{c}") + F.col(f"w{c}")).alias(f"l{c}") for c in columns], *[f"t{c}" for c in columns])

    def _grow(self, split, classes: Sequence[int], names: Sequence[str]) -> list[int]:
        if split["gain_"] < self.min_gain or min(split["ln_"], split["rn_"]) < self.min_leaf:
            return []
        node, grown = self.nodes[split["node_"]], []
        node.feature, node.threshold, node.left, node.right = self.features[split["f_"]], split["split_"], len(self.nodes), len(self.nodes) + 1
        for side in "lr":
            sums = {"n_": split[f"{side}n_"]} | {c: split[f"{side}{c}"] for c in names}
            self.nodes.append(self._leaf(sums, classes, names))
            if sums["n_"] >= self.min_split and split[f"{side}i_"] >= PURE:
                grown.append(len(self.nodes) - 1)
        return grown

    def _route(self, leaf, at: int = 0) -> Column:
        node = self.nodes[at]
        if node.feature is None:
            return F.lit(leaf(at))
        return F.when(F.col(node.feature) <= node.threshold, self._route(leaf, node.left)).otherwise(self._route(leaf, node.right))

    def node(self) -> Column:
        """The index of the row's leaf."""
        return self._route(lambda i: i)

    def predict(self) -> Column:
        cast = float if self.task == "regression" else int
        return self._route(lambda i: cast(self.nodes[i].value) if self.nodes[i].n else None)

    def probabilities(self) -> Column:
        """Of the classes in ascending order: their shares in the row's leaf."""
        shares = F.array(*[F.array(*[F.lit(x) for x in (n.shares or [None] * len(self.classes))]) for n in self.nodes])
        return F.element_at(shares, self.node() + 1)

    def transform(self, df: DataFrame) -> DataFrame:
        self.check_fitted()
        return df.withColumn("prediction", self.predict())

    def importances(self) -> dict[str, float]:
        """Shares of the rows that each feature's splits part, the root's counting most."""
        sums = {f: 0.0 for f in self.features}
        for n in self.nodes:
            if n.feature is not None:
                sums[n.feature] += n.n
        total = sum(sums.values())
        return {f: v / total if total else 0.0 for f, v in sums.items()}

    def text(self, at: int = 0, depth: int = 0) -> str:
        """Indented rules."""
        node, pad = self.nodes[at], "  " * depth
        if node.feature is None:
            return f"{pad}value: {node.value:g} (n = {node.n})\n"
        return f"{pad}if {node.feature} <= {node.threshold:g}:\n{self.text(node.left, depth + 1)}{pad}else:\n{self.text(node.right, depth + 1)}"


@dataclass
class RandomForest(Estimator):
    """Trees on Poisson bootstrap weights of the rows' keys; a class by hard votes (ties to the lowest), or the mean of the trees.

    A row's number of repeats in a tree follows from its key and the seed, so fits can be repeated at any partitioning. max_features > 0 draws so
    many features for each tree. Binned, the rows are binned once for all trees. With a bootstrap, oob_score judges rows by the trees without them."""

    learned = ("trees", "classes")

    features: Sequence[str]
    label: str
    key: str
    task: str = "classification"
    n_trees: int = 10
    max_depth: int = 10
    min_split: int = 2
    min_leaf: int = 1
    bootstrap: bool = True
    seed: int = 42
    max_features: int = 0
    bins: int | None = None
    trees: list[DecisionTree] = field(default_factory=list)
    classes: list[int] = field(default_factory=list)

    def _repeats(self, tree: int) -> Column:
        share = F.pmod(F.xxhash64(F.col(self.key), F.lit(self.seed), F.lit(tree)), F.lit(1 << 30)) / float(1 << 30)
        steps, total = [], 0.0
        for k in range(7):
            total += math.exp(-1) / math.factorial(k)
            steps.append((share >= total).cast("int"))
        return sum(steps[1:], steps[0])

    def _features(self, tree: int) -> list[str]:
        if not 0 < self.max_features < len(self.features):
            return list(self.features)
        drawn = np.random.default_rng([self.seed, tree]).choice(len(self.features), self.max_features, replace=False)
        return [self.features[i] for i in sorted(drawn.tolist())]

    def fit(self, df: DataFrame) -> RandomForest:
        kind = "double" if self.task == "regression" else "int"
        data = df.select(self.key, *[F.col(f).cast("double").alias(f) for f in self.features], F.col(self.label).cast(kind).alias(self.label)).dropna().persist()
        try:
            self.classes = [] if self.task == "regression" else [r[0] for r in data.select(self.label).distinct().orderBy(self.label).collect()]
            self.trees = []
            for t in range(self.n_trees):
                rows = data
                if self.bootstrap:
                    rows = data.withColumn("times_", self._repeats(t)).where("times_ > 0").withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("times_"))))
                self.trees.append(DecisionTree(self._features(t), self.label, self.task, max_depth=self.max_depth, min_split=self.min_split, min_leaf=self.min_leaf, bins=self.bins).fit(rows))
        finally:
            data.unpersist()
        return self

    def _voted(self, votes: Column) -> Column:
        if self.task == "regression":
            return F.try_divide(F.aggregate(votes, F.lit(0.0), lambda s, x: s + x), F.size(votes))
        ranked = F.transform(F.array_distinct(votes), lambda c: F.struct(F.size(F.filter(votes, lambda v: v == c)).alias("n"), (-c).alias("c")))
        return -F.array_max(ranked)["c"]

    def predict(self) -> Column:
        return self._voted(F.array(*[t.predict() for t in self.trees]))

    def probabilities(self) -> Column:
        """Mean over the trees of the leaf's shares, by class of the forest."""
        per_tree = [dict(zip(t.classes, range(len(t.classes)), strict=True)) for t in self.trees]
        each = [[F.get(t.probabilities(), F.lit(at[c])) if c in at else F.lit(0.0) for t, at in zip(self.trees, per_tree, strict=True)] for c in self.classes]
        return F.array(*[sum(parts[1:], parts[0]) / len(self.trees) for parts in each])

    def transform(self, df: DataFrame) -> DataFrame:
        self.check_fitted()
        out = df.withColumn("prediction", self.predict())
        return out if self.task == "regression" else out.withColumn("probabilities", self.probabilities())

    def oob_score(self, df: DataFrame) -> float:
        """Accuracy or R2 over the rows that some tree hasn't seen, by the votes of such trees."""
        from loomstat.operators.estimator import accuracy, r_squared

        votes = F.filter(F.array(*[F.when(self._repeats(t) == 0, tree.predict()) for t, tree in enumerate(self.trees)]), lambda v: v.isNotNull())
        held = df.withColumn("votes_", votes).where("size(votes_) > 0").withColumn("prediction", self._voted(F.col("votes_")))
        return (r_squared if self.task == "regression" else accuracy)(held, self.label)


@dataclass
class GradientBoosting(Estimator):
    """Regression trees on residuals; binary labels by the logistic loss from the log-odds, others by squares from the mean.

    task None takes it from the labels: classification where no integer label is above 1. Rows are binned once (`bins` None: exact splits) and carry
    their running score, so a round's plan doesn't hold the trees before it; every `KEEP` rounds the rows are written to cut their lineage.
    subsample < 1 fits each tree on so large a share, by a hash of the row and the round."""

    learned = ("trees", "start")

    features: Sequence[str]
    label: str
    task: str | None = None
    n_trees: int = 100
    learning_rate: float = 0.1
    max_depth: int = 3
    min_split: int = 2
    start: float = 0.0
    trees: list[DecisionTree] = field(default_factory=list)
    subsample: float = 1.0
    bins: int | None = 256
    seed: int = 42

    def fit(self, df: DataFrame) -> GradientBoosting:
        rows = df.select(*[F.col(f).cast("double").alias(f) for f in self.features], F.col(self.label).cast("double").alias("label_")).dropna()
        mean, top = rows.agg(F.avg("label_"), F.max(F.col("label_").cast("int"))).first()
        self.trees, self.start = [], 0.0
        self.task = self.task or ("classification" if top is not None and top <= 1 else "regression")
        if mean is None:
            return self
        share = min(max(mean, 1e-15), 1 - 1e-15)
        self.start = math.log(share / (1 - share)) if self.task == "classification" else mean
        cuts = None
        if self.bins:
            cuts = cuts_of(rows, self.features, self.bins)
            rows = binned(rows, self.features, cuts)
        now = rows.withColumn("score_", F.lit(self.start)).persist()
        for t in range(self.n_trees):
            guess = 1 / (1 + F.exp(-F.col("score_"))) if self.task == "classification" else F.col("score_")
            taken = now.withColumn("residual_", F.col("label_") - guess)
            if self.subsample < 1:
                drawn = F.pmod(F.xxhash64(*self.features, "label_", F.lit(self.seed), F.lit(t)), F.lit(1 << 30)) / float(1 << 30)
                taken = taken.where(drawn < self.subsample)
            tree = DecisionTree(self.features, "residual_", "regression", max_depth=self.max_depth, min_split=self.min_split).fit(taken, cuts)
            self.trees.append(tree)
            before, now = now, now.withColumn("score_", F.col("score_") + self.learning_rate * F.coalesce(tree.predict(), F.lit(0.0)))
            now = (checkpointed(now) if t % KEEP == KEEP - 1 else now).persist()
            now.count()
            before.unpersist()
        now.unpersist()
        return self

    def margin(self) -> Column:
        return sum((self.learning_rate * t.predict() for t in self.trees), F.lit(self.start))

    def transform(self, df: DataFrame) -> DataFrame:
        # some trees a column, so that no expression outgrows what code generation takes
        out = df.withColumn("margin_", F.lit(self.start))
        for at in range(0, len(self.trees), KEEP):
            out = out.withColumn("margin_", F.col("margin_") + sum((self.learning_rate * t.predict() for t in self.trees[at : at + KEEP]), F.lit(0.0)))
        if self.task == "regression":
            return out.withColumnRenamed("margin_", "prediction")
        out = out.withColumn("probability", 1 / (1 + F.exp(-F.col("margin_")))).drop("margin_")
        return out.withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))

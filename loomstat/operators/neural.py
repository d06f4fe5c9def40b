"""Neural networks: training by gradients that are summed over partitions, scoring as column expressions or Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.functions.vectors import activation, argmax, linear, sigmoid, softmax
from loomstat.operators.estimator import Callback, Estimator, TrainingHistory

SLOPES = {
    "identity": lambda z: np.ones_like(z),
    "sigmoid": lambda z: _squash(z) * (1 - _squash(z)),
    "tanh": lambda z: 1 - np.tanh(z) ** 2,
    "relu": lambda z: (z > 0).astype(float),
    "leaky_relu": lambda z: np.where(z > 0, 1.0, 0.01),
}
FORMS = {"identity": lambda z: z, "sigmoid": lambda z: _squash(z), "tanh": np.tanh, "relu": lambda z: np.maximum(z, 0.0), "leaky_relu": lambda z: np.where(z > 0, z, 0.01 * z)}


def _squash(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


@dataclass
class MLP(Estimator):
    """Layers of weights (outputs x inputs) and biases. Classification has a sigmoid output for each of two classes, a softmax over more.

    An epoch deals the rows into `batches` by a hash and takes one step of the optimiser for each: a job whose gradient is summed over the partitions.
    Weights start from Xavier's normal draw by `seed`, biases at 0.01; a fitted model goes on from its weights. Rows with a null aren't used."""

    learned = ("layers", "classes")

    features: Sequence[str]
    label: str
    hidden: Sequence[int] = (16,)
    task: str = "classification"
    hidden_activation: str = "relu"
    optimizer: str = "adam"
    learning_rate: float = 0.01
    epochs: int = 50
    batches: int = 1
    momentum: float = 0.9
    l2: float = 1e-4
    seed: int = 42
    layers: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    classes: list[int] = field(default_factory=list)

    def _start(self, outputs: int) -> None:
        rng = np.random.default_rng(self.seed)
        sizes = [len(self.features), *self.hidden, outputs]
        self.layers = [(rng.normal(0, math.sqrt(2.0 / (a + b)), (b, a)), np.full(b, 0.01)) for a, b in zip(sizes, sizes[1:], strict=False)]

    def _output(self, z: np.ndarray) -> np.ndarray:
        if self.task == "regression":
            return z
        if len(self.classes) <= 2:
            return _squash(z)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sums over the rows: loss, then each layer's weights and biases."""
        inputs, sums = [x], []
        for i, (w, b) in enumerate(self.layers):
            sums.append(inputs[-1] @ w.T + b)
            inputs.append(FORMS[self.hidden_activation](sums[-1]) if i < len(self.layers) - 1 else self._output(sums[-1]))
        delta = inputs[-1] - y
        clipped = np.clip(inputs[-1], 1e-12, 1 - 1e-12)
        loss = (delta**2).sum() / 2 if self.task == "regression" else -(y * np.log(clipped)).sum()
        parts = []
        for i in range(len(self.layers) - 1, -1, -1):
            parts = [(delta.T @ inputs[i]).ravel(), delta.sum(axis=0), *parts]
            if i:
                delta = (delta @ self.layers[i][0]) * SLOPES[self.hidden_activation](sums[i - 1])
        return np.concatenate([[loss], *parts])

    def fit(self, df: DataFrame, history: TrainingHistory | None = None, callback: Callback | None = None) -> MLP:
        kind = "double" if self.task == "regression" else "int"
        rows = df.select(*[F.col(f).cast("double").alias(f"x{i}_") for i, f in enumerate(self.features)], F.col(self.label).cast(kind).alias("y_")).dropna()
        rows = rows.withColumn("part_", F.pmod(F.xxhash64(*rows.columns, F.lit(self.seed)), F.lit(self.batches))).persist()
        try:
            self.classes = [] if self.task == "regression" else [r[0] for r in rows.select("y_").distinct().orderBy("y_").collect()]
            counts = {r[0]: r[1] for r in rows.groupBy("part_").count().collect()}
            if not counts:
                raise ValueError("there are no complete rows")
            if not self.layers:
                self._start(len(self.classes) or 1)
            first, second, step = 0.0, 0.0, 0
            for epoch in range(self.epochs):
                total = 0.0
                for part, n in sorted(counts.items()):
                    step += 1
                    sums = self._summed(rows.where(F.col("part_") == part))
                    total += sums[0]
                    now = np.concatenate([v.ravel() for layer in self.layers for v in layer])
                    weights = np.concatenate([np.full(v.size, v.ndim == 2) for layer in self.layers for v in layer])
                    g = sums[1:] / n + self.l2 * now * weights
                    if self.optimizer == "adam":
                        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
                        now = now - self.learning_rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
                    elif self.optimizer == "momentum":
                        first = self.momentum * first - self.learning_rate * g
                        now = now + first
                    else:
                        now = now - self.learning_rate * g
                    self._take(now)
                self.report(history, callback, epoch, total / sum(counts.values()))
        finally:
            rows.unpersist()
        return self

    def _take(self, flat: np.ndarray) -> None:
        at, layers = 0, []
        for w, b in self.layers:
            layers.append((flat[at : at + w.size].reshape(w.shape), flat[at + w.size : at + w.size + b.size]))
            at += w.size + b.size
        self.layers = layers

    def _summed(self, rows: DataFrame) -> np.ndarray:
        size = 1 + sum(w.size + b.size for w, b in self.layers)
        classes = np.array(self.classes)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(size)
            for b in batches:
                y = b["y_"].to_numpy(float)[:, None]
                total += self._gradient(b.iloc[:, : len(self.features)].to_numpy(float), y if self.task == "regression" else (y == classes).astype(float))
            yield pd.DataFrame({"at": np.arange(size), "v": total})

        out = np.zeros(size)
        for at, v in rows.drop("part_").mapInPandas(run, "at int, v double").groupBy("at").agg(F.sum("v")).collect():
            out[at] = v
        return out

    def outputs(self) -> list[Column]:
        """The forward pass as expressions over the features."""
        self.check_fitted()
        values: list[Column] = [F.col(f).cast("double") for f in self.features]
        for i, (w, b) in enumerate(self.layers):
            values = [linear(values, row, bias) for row, bias in zip(w, b, strict=True)]
            if i < len(self.layers) - 1:
                values = [activation(v, self.hidden_activation) for v in values]
        if self.task == "regression":
            return values
        return [sigmoid(v) for v in values] if len(self.classes) <= 2 else softmax(values)

    def transform(self, df: DataFrame) -> DataFrame:
        # layer by layer as columns, so that an expression isn't repeated for each that reads it
        values, out = [f"`{f}`" for f in self.features], df
        self.check_fitted()
        for i, (w, b) in enumerate(self.layers):
            columns = [linear([F.col(v).cast("double") for v in values], row, bias) for row, bias in zip(w, b, strict=True)]
            if i < len(self.layers) - 1:
                columns = [activation(c, self.hidden_activation) for c in columns]
            values = [f"h{i}_{j}_" for j in range(len(columns))]
            out = out.withColumns(dict(zip(values, columns, strict=True)))
        z = [F.col(v) for v in values]
        drop = [c for c in out.columns if c not in df.columns]
        if self.task == "regression":
            return out.withColumn("prediction", z[0]).drop(*drop)
        p = [sigmoid(v) for v in z] if len(self.classes) <= 2 else softmax(z)
        return out.withColumn("probabilities", F.array(*p)).withColumn("prediction", argmax(z, self.classes)).drop(*drop)


def out_size(size: int, kernel: int, stride: int = 1, padding: int = 0) -> int:
    return (size + 2 * padding - kernel) // stride + 1


def im2col(x: np.ndarray, kernel: int, stride: int = 1, padding: int = 0) -> np.ndarray:
    """Images n x c x h x w -> n x (c k k) x (oh ow)."""
    x = np.pad(x, ((0, 0), (0, 0), (padding, padding), (padding, padding)))
    views = np.lib.stride_tricks.sliding_window_view(x, (kernel, kernel), axis=(2, 3))[:, :, ::stride, ::stride]
    n, c, h, w = views.shape[:4]
    return views.transpose(0, 1, 4, 5, 2, 3).reshape(n, c * kernel * kernel, h * w)


@dataclass
class Conv2D:
    """Weights out x in x k x k."""

    weights: np.ndarray
    bias: np.ndarray
    stride: int = 1
    padding: int = 0

    def forward(self, x: np.ndarray) -> np.ndarray:
        out, _, k, _ = self.weights.shape
        h, w = (out_size(s, k, self.stride, self.padding) for s in x.shape[2:])
        return (self.weights.reshape(out, -1) @ im2col(x, k, self.stride, self.padding) + self.bias[:, None]).reshape(len(x), out, h, w)

    def backward(self, x: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients by the input, the weights and the bias, summed over the images."""
        out, c, k, _ = self.weights.shape
        flat = grad.reshape(len(x), out, -1)
        weights = np.einsum("nop,ncp->oc", flat, im2col(x, k, self.stride, self.padding)).reshape(self.weights.shape)
        columns = (self.weights.reshape(out, -1).T @ flat).reshape(len(x), c, k, k, *grad.shape[2:])
        wide = np.zeros((len(x), c, x.shape[2] + 2 * self.padding, x.shape[3] + 2 * self.padding))
        for i in range(k):
            for j in range(k):
                wide[:, :, i : i + self.stride * grad.shape[2] : self.stride, j : j + self.stride * grad.shape[3] : self.stride] += columns[:, :, i, j]
        p = self.padding
        return wide[:, :, p : wide.shape[2] - p, p : wide.shape[3] - p], weights, flat.sum(axis=(0, 2))


@dataclass
class MaxPool2D:
    kernel: int = 2
    stride: int = 2

    def _views(self, x: np.ndarray) -> np.ndarray:
        views = np.lib.stride_tricks.sliding_window_view(x, (self.kernel, self.kernel), axis=(2, 3))[:, :, :: self.stride, :: self.stride]
        return views.reshape(*views.shape[:4], -1)

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self._views(x).max(axis=-1)

    def backward(self, x: np.ndarray, grad: np.ndarray) -> np.ndarray:
        """Each gradient goes to its window's first largest value."""
        best, out = self._views(x).argmax(axis=-1), np.zeros_like(x, dtype=float)
        n, c, i, j = np.indices(best.shape)
        np.add.at(out, (n, c, i * self.stride + best // self.kernel, j * self.stride + best % self.kernel), grad)
        return out


@dataclass
class CNN(Estimator):
    """Inference through layers over an array column that holds channels x height x width."""

    shape: tuple[int, int, int]
    label: str = "label"
    layers: list = field(default_factory=list)

    def conv(self, weights: np.ndarray, bias: np.ndarray, stride: int = 1, padding: int = 0) -> CNN:
        self.layers.append(Conv2D(np.asarray(weights, float), np.asarray(bias, float), stride, padding))
        return self

    def pool(self, kernel: int = 2, stride: int = 2) -> CNN:
        self.layers.append(MaxPool2D(kernel, stride))
        return self

    def relu(self) -> CNN:
        self.layers.append("relu")
        return self

    def flatten(self) -> CNN:
        self.layers.append("flatten")
        return self

    def softmax(self) -> CNN:
        self.layers.append("softmax")
        return self

    def dense(self, weights: np.ndarray, bias: np.ndarray) -> CNN:
        self.layers.append((np.asarray(weights, float), np.asarray(bias, float)))
        return self

    def forward(self, x: np.ndarray) -> np.ndarray:
        for layer in self.layers:
            if isinstance(layer, str):
                if layer == "relu":
                    x = np.maximum(x, 0.0)
                elif layer == "flatten":
                    x = x.reshape(len(x), -1)
                else:
                    e = np.exp(x - x.max(axis=1, keepdims=True))
                    x = e / e.sum(axis=1, keepdims=True)
            elif isinstance(layer, tuple):
                x = x @ layer[0].T + layer[1]
            else:
                x = layer.forward(x)
        return x

    def outputs(self, vector: Column) -> Column:
        """array<double>, null for a null or a vector of another size."""
        size = math.prod(self.shape)

        @F.pandas_udf("array<double>")
        def run(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for v in vectors:
                out: list[np.ndarray | None] = [None] * len(v)
                ok = [i for i, x in enumerate(v) if x is not None and len(x) == size]
                if ok:
                    y = self.forward(np.stack([np.asarray(v.iloc[i], float) for i in ok]).reshape(-1, *self.shape))
                    for i, row in zip(ok, y.reshape(len(ok), -1), strict=True):
                        out[i] = row
                yield pd.Series(out, dtype=object)

        return run(vector)

    def transform(self, df: DataFrame, vector: str = "vector") -> DataFrame:
        out = df.withColumn("outputs", self.outputs(F.col(vector)))
        return out.withColumn("prediction", (F.array_position("outputs", F.array_max("outputs")) - 1).cast("int"))

"""What all models share: scoring, cloning, saving, a training history and callbacks."""

from __future__ import annotations

import copy
import dataclasses
import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = logging.getLogger("loomstat")

#: epoch, loss, metric
Callback = Callable[[int, float, float], None]


class NotFittedError(ValueError):
    """A model was asked for something that only a fitted one has."""


def accuracy(scored: DataFrame, label: str) -> float:
    """The share of rows whose label is the prediction; 0 without rows."""
    return scored.agg(F.coalesce(F.avg((F.col(label).cast("int") == F.col("prediction").cast("int")).cast("double")), F.lit(0.0))).first()[0]


def r_squared(scored: DataFrame, label: str) -> float:
    """1 - squared errors / variance over complete rows; 0 where the label doesn't vary."""
    e = F.col(label) - F.col("prediction")
    mse, spread = scored.where(e.isNotNull()).agg(F.avg(e * e), F.var_pop(label)).first()
    return 1 - mse / spread if spread else 0.0


@dataclass
class TrainingHistory:
    """Loss and metric of each epoch."""

    rows: list[tuple[int, float, float]] = field(default_factory=list)

    def append(self, epoch: int, loss: float, metric: float = 0.0) -> None:
        self.rows.append((epoch, float(loss), float(metric)))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "epoch int, loss double, metric double")


class Estimator:
    """A dataclass with fit(df) and transform(df), which adds `prediction`. learned: the fields that fit sets, which a clone hasn't."""

    learned: ClassVar[tuple[str, ...]] = ()
    regression: ClassVar[bool] = False

    def fitted(self) -> bool:
        for name in self.learned:
            value = getattr(self, name)
            # an intercept of 0 tells nothing, learned arrays and flags do
            if value is True or (hasattr(value, "__len__") and len(value)) or isinstance(value, Estimator):
                return True
        return not self.learned

    def check_fitted(self) -> None:
        if not self.fitted():
            raise NotFittedError(f"{type(self).__name__} isn't fitted")

    def score(self, df: DataFrame, label: str | None = None) -> float:
        """Accuracy, or R2 of a regression."""
        self.check_fitted()
        task = getattr(self, "task", None)
        regression = self.regression if task is None else task == "regression"
        return (r_squared if regression else accuracy)(self.transform(df), label or self.label)

    def clone(self) -> Any:
        """An unfitted model with the same settings."""
        init = {f.name: copy.deepcopy(getattr(self, f.name)) for f in dataclasses.fields(self) if f.init and f.name not in self.learned}
        return type(self)(**init)

    def report(self, history: TrainingHistory | None, callback: Callback | None, epoch: int, loss: float, metric: float = 0.0) -> None:
        LOG.debug("%s epoch %d: loss %g, metric %g", type(self).__name__, epoch, loss, metric)
        if history is not None:
            history.append(epoch, loss, metric)
        if callback is not None:
            callback(epoch, loss, metric)

    def save(self, spark: SparkSession, path: str) -> None:
        from loomstat.sources.models import save_model

        save_model(spark, self, path)

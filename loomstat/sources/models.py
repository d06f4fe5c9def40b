"""Models as JSON text in any store that Spark writes: class, settings and what was learned."""

from __future__ import annotations

import dataclasses
import importlib
import json
import math
from typing import Any

import numpy as np
from pyspark.sql import SparkSession

FORMAT = 1
ROOT = "loomstat.operators."


def encode(value: Any) -> Any:
    if isinstance(value, np.generic):
        value = value.item()
    if isinstance(value, float) and not math.isfinite(value):
        return {"float": repr(value)}
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    if isinstance(value, np.ndarray):
        return {"array": encode(value.tolist()), "dtype": str(value.dtype), "shape": list(value.shape)}
    if isinstance(value, tuple):
        return {"tuple": [encode(x) for x in value]}
    if isinstance(value, (list, range)):
        return [encode(x) for x in value]
    if isinstance(value, dict):
        return {"map": [[encode(k), encode(v)] for k, v in value.items()]}
    if dataclasses.is_dataclass(value) and type(value).__module__.startswith(ROOT):
        return {"class": f"{type(value).__module__}:{type(value).__qualname__}", "fields": {f.name: encode(getattr(value, f.name)) for f in dataclasses.fields(value)}}
    raise TypeError(f"{type(value).__name__} can't be saved")


def decode(value: Any) -> Any:
    if isinstance(value, list):
        return [decode(x) for x in value]
    if not isinstance(value, dict):
        return value
    if "float" in value:
        return float(value["float"])
    if "array" in value:
        return np.array(decode(value["array"]), value["dtype"]).reshape(value["shape"])
    if "tuple" in value:
        return tuple(decode(x) for x in value["tuple"])
    if "map" in value:
        return {decode(k): decode(v) for k, v in value["map"]}
    module, name = value["class"].split(":")
    if not module.startswith(ROOT):
        raise ValueError(f"{value['class']} isn't a model of this library")
    kind = getattr(importlib.import_module(module), name)
    out = object.__new__(kind)
    for field, x in value["fields"].items():
        setattr(out, field, decode(x))
    return out


def save_model(spark: SparkSession, model: Any, path: str) -> None:
    text = json.dumps({"format": FORMAT, "model": encode(model)})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> Any:
    row = spark.read.text(path).first()
    found = json.loads(row[0]) if row else {}
    if found.get("format") != FORMAT:
        raise ValueError(f"{path} holds no model of format {FORMAT}")
    return decode(found["model"])

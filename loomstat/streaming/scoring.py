"""Scoring of streams: a fitted model's transform is a projection, so it takes a streaming DataFrame as it is."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def scored_stream(model: Any, stream: DataFrame) -> DataFrame:
    """The stream with the model's columns; refuses tables, so that a batch isn't taken for a stream."""
    if not stream.isStreaming:
        raise ValueError("not a streaming DataFrame")
    return model.transform(stream)


def write_scores(model: Any, stream: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Appends scored rows as Parquet; checkpoint must be a folder that a restarted driver finds again."""
    writer = scored_stream(model, stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def continued(model: Any, stream: DataFrame, checkpoint: str) -> StreamingQuery:
    """Refits a model that goes on from its weights, such as MLP, on each micro-batch."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: model.fit(batch) and None).start()

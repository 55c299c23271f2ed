"""Applying fitted pipelines to streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from loomwright.plans.pipeline import FeaturePipelineModel


def row_wise(model: FeaturePipelineModel) -> bool:
    """True if no stage looks at other rows, so that the model can be applied to a stream as it is."""
    return all(s.ROW_WISE for s in model.stages)


def transform_stream(stream: DataFrame, model: FeaturePipelineModel) -> DataFrame:
    """The stream with the model's columns; a ValueError if the model has stages over lists of rows."""
    if not row_wise(model):
        raise ValueError("stages over lists of rows need whole lists; use write_batches")
    return model.transform(stream)


def write_batches(stream: DataFrame, model: FeaturePipelineModel, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts a query that hands each micro-batch, with the model's columns, to ``sink(rows, batch id)``.

    Lists of rows are taken as they stand in a batch. A sink that overwrites by batch id makes the
    result exactly-once.
    """
    writer = stream.writeStream.foreachBatch(lambda rows, batch: sink(model.transform(rows), batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

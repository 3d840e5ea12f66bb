"""Stateless operators on streams: filters, row-local columns and scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from timberline.functions.conditions import Condition, combine
from timberline.operators.scoring import predict
from timberline.plans.tree import TreeModel


def read_stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet",
                max_files: int | None = None) -> DataFrame:
    """Files arriving in a folder as a stream."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def score_stream(stream: DataFrame, model: TreeModel, conditions: Sequence[Condition | tuple | dict] = (),
                 threshold: float | None = None) -> DataFrame:
    """Filter and score a stream; no state is kept, so no watermark is needed."""
    rows = stream.where(combine(stream, conditions)) if conditions else stream
    return predict(rows, model, threshold)


def write_stream(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Append to files until the available input is used up."""
    return (stream.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())

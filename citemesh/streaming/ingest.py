"""Incremental ingest of record files: each run takes what is new since the last."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def ingest(spark: SparkSession, source: str, schema: str, checkpoint: str, write: Callable[[DataFrame, int], None], key: str | None = None, time_col: str | None = None, late: str = "1 day") -> None:
    """Reads new JSON files and hands each batch to write(batch, number). With a key and a time column,
    repeats that come within `late` are dropped by a watermark."""
    stream = spark.readStream.schema(schema).json(source)
    if key and time_col:
        stream = stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark([key])
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()

"""Streaming forms: the store kept up by micro-batches, and counts by window of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunks import merge
from ..sources.tables import read_store, write_store


def keep_store(calls: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Merges each micro-batch of calls (seq, raw) into a new version of the store under `folder`.

    Batch n reads version n - 1 and writes version n, so a batch that is run again gives the same version.
    """

    def apply(batch: DataFrame, n: int) -> None:
        before = read_store(batch.sparkSession, f"{folder}/version={n - 1}")
        write_store(merge(before, batch), f"{folder}/version={n}")

    return calls.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events and their value by window and type; works on a stream, whose late events are dropped after the watermark."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def file_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(folder)

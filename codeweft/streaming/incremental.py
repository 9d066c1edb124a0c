"""Incremental runs over a growing folder, and windows over an event stream (an extension of the batch operators)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def each_new(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hands what is new since the last call to ``handle`` and returns; the checkpoint remembers what has been handled."""
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def counted_windows(events: DataFrame, at: str, by: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events of each kind in each window, for streams with a bound on lateness and for batches alike."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("_at", late)
    return timed.groupBy(F.window("_at", width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), by, "n")


def sessions(events: DataFrame, at: str, by: str, gap: str = "30 minutes") -> DataFrame:
    """Runs of events of one key with no pause of ``gap`` or more."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp"))
    out = timed.groupBy(F.session_window("_at", gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(by, F.col("w.start").cast("timestamp_ntz").alias("start"), "n")

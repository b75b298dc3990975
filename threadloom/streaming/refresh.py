"""Structured Streaming: refreshing from a folder that grows, and windows over events.

The engine's own change cursor is a stored value of each source; Spark's watermark bounds the state of windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.incremental import first_of_each


def changes(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1000) -> DataFrame:
    """Rows of Parquet files as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def keep_latest(batch: DataFrame) -> DataFrame:
    """The newest row of each session in a batch."""
    return first_of_each(batch, ["uri"], F.desc("updated_at"), F.desc("content_hash"))


def refresh_available(stream: DataFrame, out: str, checkpoint: str):
    """Writes the newest rows of what is there now, then ends; a repeated batch overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        keep_latest(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The newest row of each session over all batches."""
    return first_of_each(spark.read.parquet(out), ["uri"], F.desc("updated_at"), F.desc("batch"))


def tumbling(events: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums of ``value`` by window and type; events later than ``late`` are dropped."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("w.start", "event_type", "n", "total")


def sessionized(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Bursts of each user's events, parted by gaps."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", "w.start", "w.end", "n")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])

"""Structured Streaming over append-only logs (an extension: the batch library has no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and totals by event type and event-time window; works on a stream or a table."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "events", "total")


def upsert_stream(source: DataFrame, keys: list[str], order: str, target: str, checkpoint: str):
    """Keep the latest row of each key of a log in a Parquet table, micro-batch by micro-batch.

    Each batch writes the merged table to a new version folder and then names it in a
    one-row pointer table, so a failed batch leaves the last version untouched.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        fresh = store.latest(batch, keys, [F.col(order)])
        try:
            last = spark.read.parquet(f"{target}/pointer").agg(F.max("version")).first()[0]
            fresh = store.latest(spark.read.parquet(f"{target}/v{last}").unionByName(fresh), keys, [F.col(order)])
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("overwrite").parquet(f"{target}/v{number}")
        spark.createDataFrame([(number,)], "version long").coalesce(1).write.mode("append").parquet(f"{target}/pointer")

    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    last = spark.read.parquet(f"{target}/pointer").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{target}/v{last}")

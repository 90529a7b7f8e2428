"""The usage operators on streams: the batch functions with watermarks and keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def stream_dedupe(events: DataFrame, key: str = "id", lateness: str = "1 hour") -> DataFrame:
    """First event of each id; state is dropped once the watermark passes."""
    return events.withWatermark("at", lateness).dropDuplicatesWithinWatermark([key])


def stream_daily(events: DataFrame, lateness: str = "1 hour", slide: str | None = None, length: str = "1 day") -> DataFrame:
    """Events by window of a day (or sliding); later ones than the watermark are dropped."""
    window = F.window("at", length, slide) if slide else F.window("at", length)
    grouped = events.withWatermark("at", lateness).groupBy(window.alias("w"))
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "n")


def stream_sessions(events: DataFrame, key: str, gap: str = "7 days", lateness: str = "1 hour") -> DataFrame:
    grouped = events.withWatermark("at", lateness).groupBy(key, F.session_window("at", gap).alias("w"))
    return grouped.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ends"), "n")


def available_now(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Run a stream over what is there and return the table that it leaves under a new folder: every batch's rows, or the last whole result."""
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/out/none")

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{'last' if mode == 'complete' else n}")

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out/*")

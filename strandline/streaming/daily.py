"""Daily means of readings that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_windows(readings: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", late: str = "1 hour", full: int | None = None) -> DataFrame:
    """(keys..., day, mean, n) in one-day event-time windows; works on a stream and on a table alike.

    full keeps days with exactly that many readings (24 for hourly series).
    """
    timed = readings.withColumn("_t", F.col(ts).cast("timestamp"))
    if readings.isStreaming:
        timed = timed.withWatermark("_t", late)
    days = timed.groupBy(*keys, F.window("_t", "1 day").alias("w")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    if full is not None:
        days = days.where(F.col("n") == full)
    return days.select(*keys, F.col("w.start").cast("date").alias("day"), "mean", "n")


def write_closed_days(days: DataFrame, table: str, checkpoint: str) -> None:
    """Append the days the watermark has closed; the last days stay open until later readings come."""
    query = (
        days.writeStream.outputMode("append").format("parquet").option("path", table)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()

"""Streaming audit ETL and failure windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seekspan.operators.audit import is_valid, parse_audit


def stream_audit(lines: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """R2: parse a stream of audit lines into a Parquet table by day.

    Lines that are malformed or have an unknown operation go to the partition `day=rejected`, so one pass and one sink
    are enough. The sink is exactly-once through the checkpoint.
    """
    day = F.when(is_valid(), F.date_format("ts", "yyyy-MM-dd")).otherwise(F.lit("rejected"))
    return (
        parse_audit(lines)
        .withColumn("day", day)
        .writeStream.format("parquet")
        .partitionBy("day")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_failures(
    attempts: DataFrame, size: str = "60 seconds", slide: str | None = None, session: bool = False, delay: str = "10 minutes"
) -> DataFrame:
    """Failures per key in tumbling, sliding or session windows; rows later than the watermark are dropped."""
    frame = F.session_window("ts", size) if session else F.window("ts", size, slide)
    return (
        attempts.withWatermark("ts", delay)
        .groupBy("ip", frame.alias("w"))
        .agg(F.count(F.lit(1)).alias("failures"))
        .select("ip", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "failures")
    )

"""Structured Streaming over arriving files and events: beyond what the batch pipeline needs.

State is bounded by watermarks; sinks are Spark's own, exactly once for files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def arriving(spark: SparkSession, path: str, schema, fmt: str = "parquet", per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", per_trigger).load(path)


def _timed(df: DataFrame, time_col: str) -> DataFrame:
    """Event time must be a timestamp with a zone; one without is taken in the session's."""
    return df.withColumn(time_col, F.col(time_col).cast("timestamp"))


def once_per_image(pages: DataFrame, time_col: str, content_col: str, late: str = "1 hour") -> DataFrame:
    """Pages whose content was not seen within the watermark."""
    return _timed(pages, time_col).withColumn("content_hash", F.md5(content_col)).withWatermark(time_col, late).dropDuplicatesWithinWatermark(["content_hash"])


def tumbling_counts(events: DataFrame, time_col: str = "ts", key_col: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    w = _timed(events, time_col).withWatermark(time_col, late).groupBy(F.window(time_col, width).alias("w"), key_col).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), key_col, "n")


def sessions(events: DataFrame, time_col: str = "ts", key_col: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    w = _timed(events, time_col).withWatermark(time_col, late).groupBy(F.session_window(time_col, gap).alias("w"), key_col).agg(F.count(F.lit(1)).alias("n"))
    return w.select(key_col, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything that has arrived, to Parquet, then stop."""
    q = df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    q.awaitTermination()
    return q

"""Streams of events: an extension, as nothing here is asked of the tables at rest."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream over the Parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(path)


def hourly(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Count and sum per window and type, of a stream or of a table at rest."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, by: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user: events no further apart than ``gap``."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    out = rows.groupBy(by, F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return out.select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def matching_lines(lines: DataFrame, pattern: str, column: str = "value") -> DataFrame:
    """Line-at-a-time search: the lines of a text stream with a match, and how many."""
    n = F.regexp_count(F.col(column), F.lit(pattern))
    return lines.withColumn("n", n).filter("n > 0")


def write_each(stream: DataFrame, path: str, checkpoint: str, by: Iterable[str] = ()):
    """Append a stream to Parquet files, each batch once."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.partitionBy(*by) if by else writer).outputMode("append").start()

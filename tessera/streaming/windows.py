"""Event streams: windowed counts with a watermark, and the same over a finished table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", files_at_a_time: int = 1) -> DataFrame:
    """The table's files as a stream, in the table's own schema."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_a_time).option("pathGlobFilter", name).parquet(folder)


def windowed(events: DataFrame, every: str = "1 hour", late: str = "2 hours", time_col: str = "ts", by: str = "event_type", value: str = "value") -> DataFrame:
    """(begin, by, n, total) by window. On a stream, events later than `late` are left out, and state behind that is dropped."""
    rows = events.withColumn(time_col, F.col(time_col).cast("timestamp"))
    rows = rows.withWatermark(time_col, late) if events.isStreaming else rows
    found = rows.groupBy(F.window(time_col, every), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return found.select(F.col("window.start").alias("begin"), by, "n", "total")

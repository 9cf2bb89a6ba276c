"""Structured Streaming forms of the grouped counts (the batch operators work on streams unchanged)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, glob: str = "events.parquet") -> DataFrame:
    schema = spark.read.parquet(f"{folder.rstrip('/')}/{glob}").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by event type and tumbling window; rows later than the watermark fall out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "2 days") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])

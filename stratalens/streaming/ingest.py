"""Incremental ingestion and windows over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents as they arrive in a folder of Parquet files."""
    return spark.readStream.schema(schema).parquet(path)


def first_seen(docs: DataFrame, late: str = "1 day") -> DataFrame:
    """Each content once, within the watermark; state is a digest a row and expires with it."""
    return docs.withColumn("digest", F.sha1("text")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["digest"])


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Events and their mean value by type and window; late rows within the watermark still count."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(F.col("window.start").alias("start"), "event_type", "n", "mean")

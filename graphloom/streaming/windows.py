"""An extension beyond the query language: the same bucketed counts over a stream of events.

The transformation is one function of a DataFrame, so batch and stream agree; the stream adds a watermark, after which late
events are dropped and their state is freed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def bucket_counts(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """bucket, event_type, n, total."""
    out = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.col("w.start").alias("bucket"), "event_type", "n", "total")


def bucket_counts_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket_counts(spark.read.parquet(f"{sf_dir}/events.parquet"))


def bucket_counts_stream(spark: SparkSession, folder: str, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """A streaming DataFrame over Parquet files that arrive in a folder."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    events = spark.readStream.schema(schema).parquet(folder).withWatermark("ts", late)
    return bucket_counts(events, width)

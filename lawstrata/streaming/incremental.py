"""Incremental loads by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lawstrata.sources.sinks import merge_buckets, read_buckets


def stream_table(spark: SparkSession, folder: str, like: DataFrame, files_per_batch: int = 16, glob: str | None = None) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    reader = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder)


def upsert_stream(stream: DataFrame, target: str, key: str, order: Column, checkpoint: str) -> StreamingQuery:
    """Keeps the last write of each key in a table of buckets below ``target``, which ``read_upserted`` reads.

    Each batch rewrites only the buckets that its keys fall into, as a version of its own number, so that a
    batch that is run again after a failure gives the same table. Versions older than the last two of a
    bucket are removed.
    """
    return stream.writeStream.foreachBatch(lambda batch, number: merge_buckets(batch, target, [key], order, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_upserted(spark: SparkSession, target: str) -> DataFrame | None:
    return read_buckets(spark, target)


def windowed_counts(stream: DataFrame, time: str, by: str, window: str, late: str) -> DataFrame:
    """Rows and their sum per window and kind, on event time; rows later than ``late`` are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count("*").alias("n_rows")).select(F.col("window.start").alias("window_start"), by, "n_rows")

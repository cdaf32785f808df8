"""Incremental ingest as a stream (an extension: batches of the same operators, kept up to date)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.storage import Store, stamped


def history_stream(spark: SparkSession, path: str, schema, late: str = "2 hours", files: int = 100) -> DataFrame:
    """New history files, each query once per namespace within the watermark."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    timed = raw.withColumn("event_time", F.col("start_time").cast("timestamp")).withWatermark("event_time", late)
    return timed.dropDuplicatesWithinWatermark(["namespace_id", "query_id"])


def arrivals(stream: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """Queries and runtime per time bucket and namespace."""
    return stream.groupBy(F.window("event_time", bucket), "namespace_id").agg(F.count("*").alias("queries"), F.sum("elapsed_time").alias("elapsed_time")).select(F.col("window.start").alias("bucket_start"), "namespace_id", "queries", "elapsed_time")


def into_store(stream: DataFrame, store: Store, table: str, keys: list[str], snapshot: str, checkpoint: str) -> StreamingQuery:
    """Appends micro-batches with deduplication: a batch that is run again writes the same rows."""

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.append(table, stamped(batch.drop("event_time"), snapshot), keys)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

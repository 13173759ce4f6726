"""Structured Streaming forms: windows with a watermark, appending sinks, incremental embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.providers import Embedder, embed_rows


def read_stream(spark: SparkSession, path: str, schema, files: int = 1000) -> DataFrame:
    """Parquet files as they arrive, at most ``files`` in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, event_type, events, total: counts and sums in tumbling windows; the same for streams and tables."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    found = timed.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    return found.select(F.col("window.start").alias("window_start"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, session_start, events: sessions that end after a gap."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    found = timed.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("events"))
    return found.select("user_id", F.col("session_window.start").alias("session_start"), "events")


def append(rows: DataFrame, path: str, checkpoint: str, form: str = "parquet") -> StreamingQuery:
    """Write what has arrived and stop; running it again goes on where it stopped."""
    return rows.writeStream.format(form).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def embed_new(rows: DataFrame, key: str, text: str, embedder: Embedder, path: str, checkpoint: str, kind: str = "chunk") -> StreamingQuery:
    """Embed the rows whose key has no vector yet: a batch that is run again adds nothing twice."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        try:
            fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
        except Exception as error:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(error):
                raise
        embed_rows(fresh, key, text, embedder, kind).write.mode("append").parquet(path)

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

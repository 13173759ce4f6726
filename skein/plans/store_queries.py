"""Queries over constraints, upserts, prefixes and events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.providers import HashEmbedder
from skein.session import checkpoint_path
from skein.sources import readers, store
from skein.streaming import streams
from skein.plans.tables import table


def unique_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Relations that break uniqueness of source, target and type."""
    return store.repeated_keys(table(spark, folder, "relationships"), ["source_title", "target_title", "relation_type"])


def upsert_last_wins(spark: SparkSession, folder: str) -> DataFrame:
    """The last relation of each source, target and type stays."""
    rows = table(spark, folder, "relationships").select("source_title", "target_title", "relation_type", "id", "human_readable_id")
    return store.last_wins(rows, ["source_title", "target_title", "relation_type"], "human_readable_id").select("id")


def graph_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "entities").select(F.concat(F.when(F.col("human_readable_id") % 2 == 0, "DL").otherwise("LLM"), F.lit("__"), F.coalesce("entity_type", F.lit("Entity")), F.lit("__")).alias("label"))
    return store.label_prefixes(labels)


def refetched_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The last fetch of each URL."""
    rows = table(spark, folder, "crawl_pages").where("url IS NOT NULL").select("url", "page_id", "crawled_at")
    return rows.groupBy("url").agg(F.max_by("page_id", F.struct("crawled_at", "page_id")).alias("page_id"), F.count(F.lit(1)).alias("fetches"))


def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    return streams.event_windows(table(spark, folder, "events")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", F.round("total", 4).alias("total"))


def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return streams.sessions(table(spark, folder, "events")).select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "events")


def _place(df: DataFrame, name: str) -> str:
    """A folder of its own for one run of a stream."""
    return f"{checkpoint_path(df)}/{name}-{uuid.uuid4().hex}"


def _arriving(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows = table(spark, folder, name)
    # As a pattern, because a table may be one file or a folder of files.
    return streams.read_stream(spark, f"{folder}/{name}.parque[t]", rows.schema)


def streamed_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly windows of the events as a stream writes them: those that its watermark has closed."""
    at = _place(table(spark, folder, "events"), "windows")
    streams.append(streams.event_windows(_arriving(spark, folder, "events")), f"{at}/out", f"{at}/log").awaitTermination()
    return spark.read.parquet(f"{at}/out").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", F.round("total", 4).alias("total"))


def streamed_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Documents embedded as they arrive, by a stream that is run twice and adds nothing the second time."""
    at = _place(table(spark, folder, "documents"), "vectors")
    for run in ("first", "second"):
        streams.embed_new(_arriving(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text", HashEmbedder(64), f"{at}/out", f"{at}/{run}").awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("doc_id").agg(F.count(F.lit(1)).alias("vectors"), F.max(F.size("embedding")).alias("width"))


def streamed_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages appended to JSON as they arrive, and read back with the page reader."""
    at = _place(table(spark, folder, "crawl_pages"), "pages")
    arriving = _arriving(spark, folder, "crawl_pages").select("chunk", "url", F.col("crawled_at").cast("string").alias("timestamp"))
    streams.append(arriving, f"{at}/out", f"{at}/log", "json").awaitTermination()
    return readers.page_json(spark, f"{at}/out", lines=True).groupBy("url").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("chunk")).alias("chars"))


QUERIES = {f.__name__: f for f in (unique_violations, upsert_last_wins, graph_prefixes, refetched_pages, event_windows, event_sessions, streamed_windows, streamed_embeddings, streamed_pages)}

SQL = {
    "streamed_windows": "SELECT * FROM (SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2) WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
    "streamed_embeddings": "SELECT doc_id, count(DISTINCT doc_id) AS vectors, CAST(64 AS INTEGER) AS width FROM documents GROUP BY doc_id",
    "streamed_pages": "SELECT url, count(*) AS pages, CAST(sum(length(chunk)) AS BIGINT) AS chars FROM crawl_pages WHERE chunk IS NOT NULL GROUP BY url",
    "unique_violations": "SELECT source_title, target_title, relation_type, count(*) AS n FROM relationships GROUP BY ALL HAVING count(*) > 1",
    "upsert_last_wins": "SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY source_title, target_title, relation_type ORDER BY human_readable_id DESC) AS k FROM relationships) WHERE k = 1",
    "graph_prefixes": "SELECT DISTINCT CASE WHEN human_readable_id % 2 = 0 THEN 'DL' ELSE 'LLM' END AS graph_prefix FROM entities",
    "refetched_pages": "SELECT url, page_id, fetches FROM (SELECT url, page_id, count(*) OVER (PARTITION BY url) AS fetches, row_number() OVER (PARTITION BY url ORDER BY crawled_at DESC, page_id DESC) AS k FROM crawl_pages WHERE url IS NOT NULL) WHERE k = 1",
    "event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "event_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events), n AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS events FROM n GROUP BY user_id, session",
}

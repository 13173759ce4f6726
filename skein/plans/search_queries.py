"""Queries that search the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import word_count
from skein.operators import graph, search
from skein.operators.retrieval import boosted
from skein.plans.tables import table


def _graph(spark: SparkSession, folder: str) -> tuple[search.Graph, list[float]]:
    """Entities with the vector of their number, documents as chunks, first letters as communities; the query is vector 0."""
    points = table(spark, folder, "embeddings")
    entities = table(spark, folder, "entities")
    with_vector = entities.join(points.select(F.col("vec_id").alias("human_readable_id"), "embedding"), "human_readable_id", "left")
    chunks = table(spark, folder, "documents").join(points.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    chunks = chunks.select(F.col("doc_id").cast("string").alias("chunk_id"), "title", "text", word_count(F.col("text")).alias("n_tokens"), "embedding")
    held = entities.select(F.col("id").alias("entity_id"), F.explode(F.array(F.col("human_readable_id").cast("string"), (F.col("human_readable_id") + 1).cast("string"))).alias("chunk_id"))
    letters = with_vector.withColumn("community", F.substring("title", 1, 1))
    rows = letters.groupBy("community").agg(F.lit(0).alias("level"), F.round(F.avg("degree"), 6).alias("rank"), F.min_by("embedding", "human_readable_id").alias("embedding"))
    found = graph.related_edges(table(spark, folder, "relationships"), entities)
    parts = search.Graph(with_vector, found, chunks, held, rows, letters.select("community", F.col("id").alias("node")))
    return parts, list(points.where("vec_id = 0").first()["embedding"])


def _names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "entities").where("human_readable_id < 3").select(F.lower("title").alias("name"))


def community_relevance(spark: SparkSession, folder: str) -> DataFrame:
    parts, query = _graph(spark, folder)
    weights = search.entities_by_vector(parts, query, 15, 0.5).select(F.col("id").alias("node"), F.col("score").alias("weight"))
    return search.community_relevance(parts.communities, parts.members, weights).select("community", F.round("score", 6).alias("score"))


def community_candidates(spark: SparkSession, folder: str) -> DataFrame:
    parts, query = _graph(spark, folder)
    return search.community_candidates(parts, query, _names(spark, folder), 0).select("community", "source", F.round("relevance", 6).alias("relevance"))


def chunk_boost(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as chunks of their source; those with an even number come from seeds."""
    chunks = table(spark, folder, "documents").where("text IS NOT NULL").select(F.col("source").alias("entity_id"), F.col("doc_id").alias("chunk_id"), "text", ((F.col("doc_id") % 97) / 100.0).alias("relevance"), (F.col("doc_id") % 2 == 0).alias("is_seed"))
    return boosted(chunks).select("chunk_id", F.round("score", 6).alias("score"))


def local_search(spark: SparkSession, folder: str) -> DataFrame:
    parts, query = _graph(spark, folder)
    return search.local_search(parts, query, _names(spark, folder))


def drift_search(spark: SparkSession, folder: str) -> DataFrame:
    parts, query = _graph(spark, folder)
    return search.drift_search(parts, query, _names(spark, folder))


def global_search(spark: SparkSession, folder: str) -> DataFrame:
    parts, query = _graph(spark, folder)
    return search.global_search(parts, query)


QUERIES = {f.__name__: f for f in (community_relevance, community_candidates, chunk_boost, local_search, drift_search, global_search)}

_G = """q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0),
e AS (SELECT id, left(title, 1) AS community, human_readable_id AS n, degree, description, lower(title) AS name, CAST(v.embedding AS DOUBLE[]) AS v FROM entities LEFT JOIN embeddings v ON v.vec_id = human_readable_id),
c AS (SELECT community, round(avg(degree), 6) AS rank, arg_min(v, n) AS v FROM e GROUP BY community),
w AS (SELECT id, (1 + list_cosine_similarity(v, q)) / 2 AS weight FROM e, q WHERE v IS NOT NULL AND description IS NOT NULL)"""

SQL = {
    "community_relevance": f"WITH {_G}, t AS (SELECT * FROM w WHERE weight > 0.5 ORDER BY weight DESC, id LIMIT 15) SELECT c.community, round(0.7 * coalesce(s, 0) + 0.2 * coalesce(rank, 0), 6) AS score FROM c LEFT JOIN (SELECT community, sum(weight) AS s FROM t JOIN e USING (id) GROUP BY community) USING (community)",
    "community_candidates": f"""WITH {_G}, n AS (SELECT lower(title) AS name FROM entities WHERE human_readable_id < 3), h AS (SELECT community FROM (SELECT DISTINCT community, rank FROM e JOIN c USING (community) WHERE name IN (SELECT name FROM n)) ORDER BY rank DESC, community LIMIT 6),
        s AS (SELECT community, (1 + list_cosine_similarity(v, q)) / 2 AS score FROM c, q WHERE v IS NOT NULL)
        SELECT community, CASE WHEN community IN (SELECT community FROM h) THEN 'entity' ELSE 'vector' END AS source, round(CASE WHEN community IN (SELECT community FROM h) THEN 1 ELSE score END, 6) AS relevance
        FROM s WHERE score >= 0.2 OR community IN (SELECT community FROM h) ORDER BY relevance DESC, community LIMIT 30""",
    "chunk_boost": """WITH b AS (SELECT source, doc_id, text, (doc_id % 97) / 100.0::DOUBLE + CASE WHEN doc_id % 2 = 0 THEN 0.02::DOUBLE ELSE 0.01::DOUBLE END AS score FROM documents WHERE text <> ''), t AS (SELECT * FROM b ORDER BY score DESC, source, doc_id LIMIT 30)
        SELECT doc_id AS chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, source, doc_id) AS k FROM t) WHERE k = 1""",
}

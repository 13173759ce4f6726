"""Queries over vectors: dense, sparse and hybrid search, thresholds, reranking, contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import vectors as V
from skein.operators import context, retrieval
from skein.plans.tables import table

EVERY = 20


def _points(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings")


def _asked(points: DataFrame) -> DataFrame:
    return points.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def _scored(found: DataFrame) -> DataFrame:
    return found.withColumn("score", F.round("score", 6))


def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    points = _points(spark, folder)
    return _scored(retrieval.nearest(points, _asked(points), 10)).select("query_id", "vec_id", "rank", "score")


def entities_by_vector_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """At most five points above 0.6 on the scale of (1 + cosine) / 2."""
    points = _points(spark, folder)
    found = retrieval.nearest(points, _asked(points), 5, threshold=0.2)
    return found.select("query_id", "vec_id", F.round((1 + F.col("score")) / 2, 6).alias("score"))


def entity_weights(spark: SparkSession, folder: str) -> DataFrame:
    points = _points(spark, folder)
    found = retrieval.nearest(points, _asked(points), 5, threshold=0.4)
    return found.select("query_id", "vec_id", F.round((1 + F.col("score")) / 2, 6).alias("weight"))


def cosine_rerank(spark: SparkSession, folder: str) -> DataFrame:
    """Of 40 candidates each, those with a raw cosine above 0.5, the best twelve."""
    points = _points(spark, folder)
    candidates = retrieval.nearest(points, _asked(points), 40)
    kept = candidates.where("score > 0.5").drop("rank")
    return _scored(retrieval.top_per_group(kept, ["query_id"], [F.desc("score"), F.col("vec_id")], 12)).select("query_id", "vec_id", "rank", "score")


def label_topk_per_group(spark: SparkSession, folder: str) -> DataFrame:
    """The two points of each label nearest to point 0; one query row, so a broadcast of one row."""
    points = _points(spark, folder)
    query = points.where("vec_id = 0").select(F.col("embedding").alias("q"))
    scored = points.crossJoin(F.broadcast(query)).select("label", "vec_id", V.cosine01(F.col("embedding"), F.col("q")).alias("score"))
    return _scored(retrieval.top_per_group(scored, ["label"], [F.desc("score"), F.col("vec_id")], 2)).select("label", "vec_id", "rank", "score")


def label_mean_relevance(spark: SparkSession, folder: str) -> DataFrame:
    """Mean relevance of each label's points to point 0, blended with the size of the label."""
    points = _points(spark, folder)
    query = points.where("vec_id = 0").select(F.col("embedding").alias("q"))
    scored = points.crossJoin(F.broadcast(query)).select("label", V.cosine01(F.col("embedding"), F.col("q")).alias("score"))
    means = scored.groupBy("label").agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("points"))
    return means.select("label", "points", F.round(0.6 * F.col("mean") + 0.4 * F.lit(1.0) / F.col("points"), 6).alias("blended"))


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, with their vector where they have one."""
    points = _points(spark, folder).select(F.col("vec_id").alias("doc_id"), "embedding")
    return table(spark, folder, "documents").join(points, "doc_id", "left")


def _questions(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The vectors of the asking documents that have one, and the texts of all of them."""
    asked = chunks.where((F.col("doc_id") % EVERY == 0) & F.col("text").isNotNull())
    return asked.where(F.col("embedding").isNotNull()).select("doc_id", "embedding"), asked.select("doc_id", "text")


def bm25_tf_topk(spark: SparkSession, folder: str) -> DataFrame:
    chunks = _chunks(spark, folder)
    return _scored(retrieval.sparse_search(chunks, _questions(chunks)[1], 4)).select("query_id", "doc_id", "score")


def _hybrid(spark: SparkSession, folder: str) -> DataFrame:
    chunks = _chunks(spark, folder)
    vectors, questions = _questions(chunks)
    return retrieval.hybrid_search(chunks, chunks, vectors, questions, 4)


def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(_hybrid(spark, folder)).select("query_id", "doc_id", "rank", "score")


def vector_strategies(spark: SparkSession, folder: str) -> DataFrame:
    """Dense, sparse and hybrid results of every question in one frame."""
    chunks = _chunks(spark, folder)
    vectors, questions = _questions(chunks)
    dense, sparse = retrieval.nearest(chunks, vectors, 20, "doc_id"), retrieval.sparse_search(chunks, questions, 20)
    out = None
    for name, found in (("dense", dense), ("sparse", sparse), ("hybrid", retrieval.fuse([dense, sparse], 4, "doc_id"))):
        part = _scored(found.where("rank <= 4").select(F.lit(name).alias("strategy"), "query_id", "doc_id", "rank", "score"))
        out = part if out is None else out.unionByName(part)
    return out


def context_assembly(spark: SparkSession, folder: str) -> DataFrame:
    return context.vector_context(_hybrid(spark, folder), table(spark, folder, "documents"))


def sparse_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The sparse vector of every document as rows (doc_id, term, weight), weighted by frequency and length."""
    from skein.functions import text as T

    terms = table(spark, folder, "documents").select("doc_id", T.terms(F.col("text")).alias("t")).where(F.size("t") > 0)
    rows = terms.select("doc_id", F.size("t").alias("length"), F.explode("t").alias("term"))
    counted = rows.groupBy("doc_id", "length", "term").agg(F.count(F.lit(1)).alias("n"))
    weight = F.col("n") * (retrieval.K1 + 1) / (F.col("n") + retrieval.K1 * (1 - retrieval.B + retrieval.B * F.col("length") / retrieval.AVERAGE_LENGTH))
    return counted.select("doc_id", "term", F.round(weight, 6).alias("weight"))


QUERIES = {
    f.__name__: f
    for f in (dense_topk, entities_by_vector_threshold, entity_weights, cosine_rerank, label_topk_per_group, label_mean_relevance, bm25_tf_topk, rrf_fusion, vector_strategies, context_assembly, sparse_vectors)
}

_COS = """
v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, p.vec_id, p.label, list_cosine_similarity(q.e, p.e) AS score FROM v q, v p WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
"""
_ZERO = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT p.label, p.vec_id, (1 + list_cosine_similarity(q.e, p.e)) / 2 AS score FROM v q, v p WHERE q.vec_id = 0)"
_BM = """
c AS (SELECT d.doc_id, d.text, regexp_extract_all(lower(d.text), '[a-z0-9]+') AS t, CAST(e.embedding AS DOUBLE[]) AS e FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
dt AS (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM c WHERE text IS NOT NULL),
dw AS (SELECT doc_id, term, n * 2.2 / (n + 1.2 * (0.25 + 0.75 * l / 256.0)) AS w FROM (SELECT doc_id, l, term, CAST(count(*) AS DOUBLE) AS n FROM dt GROUP BY ALL)),
q AS (SELECT doc_id AS query_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM c WHERE doc_id % 20 = 0 AND text IS NOT NULL),
qt AS (SELECT query_id, len(t) AS l, unnest(t) AS term FROM q),
qw AS (SELECT query_id, term, n * 2.2 / (n + 1.2 * (0.25 + 0.75 * l / 256.0)) AS w FROM (SELECT query_id, l, term, CAST(count(*) AS DOUBLE) AS n FROM qt GROUP BY ALL)),
sp AS (SELECT query_id, doc_id, round(sum(qw.w * dw.w), 9) AS score FROM qw JOIN dw USING (term) GROUP BY query_id, doc_id),
sr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sp),
de AS (SELECT a.doc_id AS query_id, b.doc_id, list_cosine_similarity(a.e, b.e) AS score FROM c a, c b WHERE a.doc_id % 20 = 0 AND a.text IS NOT NULL AND a.e IS NOT NULL AND b.e IS NOT NULL),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM de),
u AS (SELECT query_id, doc_id, rank FROM dr WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, rank FROM sr WHERE rank <= 20),
f AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM u GROUP BY query_id, doc_id),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f)
"""

SQL = {
    "dense_topk": f"WITH {_COS} SELECT query_id, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10",
    "entities_by_vector_threshold": f"WITH {_COS} SELECT query_id, vec_id, round((1 + score) / 2, 6) AS score FROM r WHERE rank <= 5 AND (1 + score) / 2 > 0.6",
    "entity_weights": f"WITH {_COS} SELECT query_id, vec_id, round((1 + score) / 2, 6) AS weight FROM r WHERE rank <= 5 AND (1 + score) / 2 > 0.7",
    "cosine_rerank": f"WITH {_COS} SELECT query_id, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= 12 AND score > 0.5",
    "label_topk_per_group": f"WITH {_ZERO} SELECT label, vec_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 2",
    "label_mean_relevance": f"WITH {_ZERO} SELECT label, count(*) AS points, round(0.6 * avg(score) + 0.4 / count(*), 6) AS blended FROM s GROUP BY label",
    "bm25_tf_topk": f"WITH {_BM} SELECT query_id, doc_id, round(score, 6) AS score FROM sr WHERE rank <= 4",
    "rrf_fusion": f"WITH {_BM} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM h WHERE rank <= 4",
    "vector_strategies": f"""WITH {_BM}, a AS (SELECT 'dense' AS strategy, query_id, doc_id, rank, score FROM dr WHERE rank <= 4 UNION ALL SELECT 'sparse', query_id, doc_id, rank, score FROM sr WHERE rank <= 4 UNION ALL SELECT 'hybrid', query_id, doc_id, rank, score FROM h WHERE rank <= 4)
        SELECT strategy, query_id, doc_id, rank, round(score, 6) AS score FROM a""",
    "context_assembly": f"WITH {_BM} SELECT query_id, string_agg('title: ' || coalesce(d.title, '') || ' text: ' || coalesce(d.text, ''), chr(10) || chr(10) ORDER BY rank) AS context FROM h JOIN documents d USING (doc_id) WHERE rank <= 4 GROUP BY query_id",
    "sparse_vectors": """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM t),
        n AS (SELECT doc_id, l, term, CAST(count(*) AS DOUBLE) AS n FROM r GROUP BY ALL) SELECT doc_id, term, round(n * 2.2 / (n + 1.2 * (1 - 0.75 + 0.75 * l / 256.0)), 6) AS weight FROM n""",
}

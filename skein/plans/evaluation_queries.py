"""Queries over questions, answers and their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import vectors as V
from skein.operators import evaluation as EV
from skein.operators import qa
from skein.operators.retrieval import first_wins
from skein.plans.tables import table

SCORES = ["context_precision", "recall", "relevancy", "rouge1", "cosine_similarity"]


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "metric_records")


def rouge1(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder).select("record_id", F.round(EV.rouge1(F.col("actual_output"), F.col("expected_output")), 6).alias("rouge1"))


def answer_cosine(spark: SparkSession, folder: str) -> DataFrame:
    """Clipped cosine of each vector with the next."""
    points = table(spark, folder, "embeddings")
    after = points.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return points.join(after, "vec_id", "left").select("vec_id", F.round(V.clipped(V.cosine(F.col("embedding"), F.col("other"))), 6).alias("score"))


def _verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder).select("record_id", EV.context_verdicts(F.col("retrieval_context"), F.col("expected_output")).alias("v"))


def contextual_precision(spark: SparkSession, folder: str) -> DataFrame:
    return _verdicts(spark, folder).select("record_id", F.round(EV.ranked_precision(F.col("v")), 6).alias("score"))


def contextual_recall(spark: SparkSession, folder: str) -> DataFrame:
    return _verdicts(spark, folder).select("record_id", F.round(EV.share(F.col("v")), 6).alias("score"))


def answer_relevancy(spark: SparkSession, folder: str) -> DataFrame:
    """Share of the answer's sentences that share a term of four letters or more with the question."""
    return _records(spark, folder).select("record_id", F.round(EV.share(EV.relevancy_verdicts(F.col("actual_output"), F.col("query"))), 6).alias("score"))


def fallback_flags(spark: SparkSession, folder: str) -> DataFrame:
    rows = _records(spark, folder).select("record_id", "relevancy", F.coalesce("fallback_used_and_succeeded_relevancy", F.lit(False)).alias("used"))
    attempts = rows.select("record_id", F.lit("relevancy").alias("metric"), F.inline(F.array(
        F.struct(F.lit("primary").alias("model"), F.lit(1).alias("attempt"), F.when(~F.col("used"), F.col("relevancy")).alias("score")),
        F.struct(F.lit("fallback").alias("model"), F.lit(1).alias("attempt"), F.when(F.col("used"), F.col("relevancy")).alias("score")))))
    return EV.resolve_attempts(attempts)


def metric_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return EV.rollup(_records(spark, folder), ["search_type", "qa_level"], SCORES)


def metric_cube(spark: SparkSession, folder: str) -> DataFrame:
    """All records, each strategy, and each strategy with level, in one pass."""
    rows = _records(spark, folder).withColumns({"search_type": F.coalesce("search_type", F.lit("?")), "qa_level": F.coalesce("qa_level", F.lit("?"))})
    return rows.rollup("search_type", "qa_level").agg(F.count(F.lit(1)).alias("records"), F.round(F.avg("time_taken"), 6).alias("mean_time"))


def metric_timestamps(spark: SparkSession, folder: str) -> DataFrame:
    return EV.with_timestamps(_records(spark, folder).select("record_id"), ["record_id"], "2026-01-01 00:00:00")


def score_projection(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder).select("record_id", *(F.coalesce(s, F.lit(0.0)).alias(s) for s in SCORES))


def token_usage(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder).groupBy("search_type").agg(F.sum("num_input_token").alias("input_tokens"), F.sum("num_output_token").alias("output_tokens"), F.sum(F.coalesce("num_input_token", F.lit(0)) + F.coalesce("num_output_token", F.lit(0))).alias("total_tokens"))


def appended_twice(spark: SparkSession, folder: str) -> DataFrame:
    """The first record of each appended pair: same strategy, question, answer and time."""
    keys = ["search_type", "query", "actual_output", "created_at"]
    return first_wins(_records(spark, folder).select("record_id", *keys), keys, [F.col("record_id")]).select("record_id")


def late_records(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder).where(F.col("loaded_at") > F.col("created_at") + F.expr("INTERVAL 1 DAY")).groupBy("search_type").agg(F.count(F.lit(1)).alias("late"))


def qa_valid(spark: SparkSession, folder: str) -> DataFrame:
    return qa.valid(table(spark, folder, "qa_pairs")).select("qa_id")


def qa_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return qa.without_repeats(table(spark, folder, "qa_pairs"), ["qa_id"]).select("qa_id", "qa_level")


def qa_flatten(spark: SparkSession, folder: str) -> DataFrame:
    """The question set as one nested JSON object per pair and flat again."""
    pair = F.to_json(F.map_from_arrays(F.array("qa_level"), F.array(F.array(F.struct("question", "answer")))))
    flat = qa.flatten(table(spark, folder, "qa_pairs").where("qa_level IS NOT NULL").select(pair.alias("nested")), "nested")
    return flat.groupBy("qa_level").agg(F.count(F.lit(1)).alias("pairs"), F.count("answer").alias("answers"))


def strategy_fan_out(spark: SparkSession, folder: str) -> DataFrame:
    return qa.fan_out(table(spark, folder, "qa_pairs").select("qa_id"))


QUERIES = {
    f.__name__: f
    for f in (rouge1, answer_cosine, contextual_precision, contextual_recall, answer_relevancy, fallback_flags, metric_rollup, metric_cube, metric_timestamps, score_projection, token_usage, appended_twice,
              late_records, qa_valid, qa_dedup, qa_flatten, strategy_fan_out)
}

_T = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
_V = f"""v AS (SELECT record_id, i, CASE WHEN len(list_intersect(list_distinct({_T.format('parts[i]')}), w)) >= 3 THEN 1 ELSE 0 END AS v FROM (SELECT record_id, parts, w, unnest(range(1, len(parts) + 1)) AS i FROM
  (SELECT record_id, string_split(retrieval_context, '. ') AS parts, {_T.format('expected_output')} AS w FROM metric_records WHERE retrieval_context IS NOT NULL)))"""
_BLANK = "coalesce(length(regexp_replace({0}, '[ \\t\\n\\r\\f]+', '', 'g')) = 0, true)"

SQL = {
    "rouge1": f"""WITH t AS (SELECT record_id, {_T.format('actual_output')} AS a, {_T.format('expected_output')} AS b FROM metric_records),
        s AS (SELECT record_id, sum(least(x.n, y.n)) AS n FROM (SELECT record_id, w, count(*) AS n FROM (SELECT record_id, unnest(a) AS w FROM t) GROUP BY ALL) x JOIN (SELECT record_id, w, count(*) AS n FROM (SELECT record_id, unnest(b) AS w FROM t) GROUP BY ALL) y USING (record_id, w) GROUP BY record_id)
        SELECT record_id, round(coalesce(CASE WHEN len(a) > 0 AND len(b) > 0 THEN 2.0::DOUBLE * coalesce(n, 0) / (len(a) + len(b)) END, 0), 6) AS rouge1 FROM t LEFT JOIN s USING (record_id)""",
    "answer_cosine": "SELECT a.vec_id, round(coalesce(least(1, greatest(0, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 0), 6) AS score FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "contextual_precision": f"WITH {_V}, k AS (SELECT record_id, i, v, sum(v) OVER (PARTITION BY record_id ORDER BY i) / CAST(i AS DOUBLE) AS p FROM v) SELECT r.record_id, round(coalesce(s, 0), 6) AS score FROM metric_records r LEFT JOIN (SELECT record_id, sum(p * v) / nullif(sum(v), 0) AS s FROM k GROUP BY record_id) USING (record_id)",
    "contextual_recall": f"WITH {_V} SELECT r.record_id, round(s, 6) AS score FROM metric_records r LEFT JOIN (SELECT record_id, avg(v) AS s FROM v GROUP BY record_id) USING (record_id)",
    "answer_relevancy": f"""WITH p AS (SELECT record_id, string_split(actual_output, '. ') AS parts, list_filter({_T.format('query')}, lambda t: length(t) >= 4) AS w FROM metric_records WHERE actual_output IS NOT NULL),
        v AS (SELECT record_id, CASE WHEN len(list_intersect(list_distinct({_T.format('s')}), w)) > 0 THEN 1 ELSE 0 END AS v FROM (SELECT record_id, w, unnest(parts) AS s FROM p))
        SELECT r.record_id, round(s, 6) AS score FROM metric_records r LEFT JOIN (SELECT record_id, avg(v) AS s FROM v GROUP BY record_id) USING (record_id)""",
    "fallback_flags": "SELECT record_id, 'relevancy' AS metric, relevancy AS score, coalesce(fallback_used_and_succeeded_relevancy, false) AND relevancy IS NOT NULL AS fallback_used_and_succeeded, relevancy IS NULL AS final_state_failed FROM metric_records",
    "metric_rollup": "SELECT search_type, qa_level, count(*) AS records, " + ", ".join(f"round(avg(coalesce({s}, 0)), 6) AS {s}" for s in SCORES) + " FROM metric_records GROUP BY search_type, qa_level",
    "metric_cube": "SELECT search_type, qa_level, count(*) AS records, round(avg(time_taken), 6) AS mean_time FROM (SELECT coalesce(search_type, '?') AS search_type, coalesce(qa_level, '?') AS qa_level, time_taken FROM metric_records) GROUP BY ROLLUP (search_type, qa_level)",
    "metric_timestamps": "SELECT record_id, TIMESTAMP '2026-01-01 00:00:00' + to_seconds(row_number() OVER (ORDER BY record_id) - 1) AS created_at FROM metric_records",
    "score_projection": "SELECT record_id, " + ", ".join(f"coalesce({s}, 0) AS {s}" for s in SCORES) + " FROM metric_records",
    "token_usage": "SELECT search_type, CAST(sum(num_input_token) AS BIGINT) AS input_tokens, CAST(sum(num_output_token) AS BIGINT) AS output_tokens, CAST(sum(coalesce(num_input_token, 0) + coalesce(num_output_token, 0)) AS BIGINT) AS total_tokens FROM metric_records GROUP BY search_type",
    "appended_twice": "SELECT min(record_id) AS record_id FROM metric_records GROUP BY search_type, query, actual_output, created_at",
    "late_records": "SELECT search_type, count(*) AS late FROM metric_records WHERE loaded_at > created_at + INTERVAL 1 DAY GROUP BY search_type",
    "qa_valid": f"SELECT qa_id FROM qa_pairs WHERE NOT {_BLANK.format('question')} AND NOT {_BLANK.format('answer')}",
    "qa_dedup": "SELECT qa_id, qa_level FROM (SELECT *, row_number() OVER (PARTITION BY qa_level, question ORDER BY qa_id) AS k FROM qa_pairs) WHERE k = 1",
    "qa_flatten": "SELECT qa_level, count(*) AS pairs, count(answer) AS answers FROM qa_pairs WHERE qa_level IS NOT NULL GROUP BY qa_level",
    "strategy_fan_out": "SELECT qa_id, unnest(['dense', 'sparse', 'hybrid', 'DL_local', 'DL_drift', 'DL_global', 'LLM_local', 'LLM_drift', 'LLM_global']) AS search_type FROM qa_pairs",
}

"""Queries whose values a model writes, with deterministic stand-ins that SQL can repeat."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import around
from skein.operators import evaluation as EV
from skein.operators import generation as G
from skein.operators.chunking import token_windows
from skein.operators.retrieval import top_per_group
from skein.plans.community_queries import _inside, _members
from skein.plans.tables import table
from skein.providers import OverlapJudge, Scripted, fail, fenced, first_words, pattern_triplets

KINDS = ["ORBITS", "PART_OF", "STUDIED_BY"]


def chunk_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks numbered from 1 with a title of their first eight words."""
    chunks = token_windows(table(spark, folder, "documents"), "doc_id", "text").select("doc_id", "pos", "chunk")
    return G.titles(chunks, ["doc_id", "pos"], "chunk", lambda: Scripted("titles", first_words(8)), delay=0).select("id", "doc_id", "pos", "title")


def _first_sentence(material: str) -> str:
    asked = json.loads(material)
    if not asked["context"]:
        raise ValueError("no context")
    return asked["context"].split(". ")[0]


def model_answers(spark: SparkSession, folder: str) -> DataFrame:
    """The first sentence of the context answers; without a context the error does."""
    rows = table(spark, folder, "metric_records").select("record_id", F.col("query").alias("question"), F.col("retrieval_context").alias("context"))
    return G.answers(rows, "record_id", lambda: Scripted("first", _first_sentence)).select("record_id", "answer", "model", "tries", (F.col("total_tokens") == F.col("prompt_tokens") + F.col("completion_tokens")).alias("adds_up"))


def model_triplets(spark: SparkSession, folder: str) -> DataFrame:
    """Triplets that a model reads in lines of head, type and tail, of three allowed types."""
    rows = table(spark, folder, "relationships").select("id", F.concat_ws(" | ", F.trim("source_title"), F.upper(F.trim("relation_type")), F.coalesce(F.trim("target_title"), F.lit(""))).alias("line"))
    return G.model_triplets(rows, "id", "line", KINDS, lambda: Scripted("lines", pattern_triplets(r"^([^|]*) \| ([^|]*) \| ([^|]*)$")), delay=0).select("id", "head", "type", "tail")


def discovered_types(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "entities").where("entity_type IS NOT NULL").select("id", "entity_type")
    return G.discovered_types(rows, "id", "entity_type", lambda: Scripted("types", lambda m: fenced([m])), delay=0)


def _levels(material: str) -> str:
    return fenced({f"level_{k}": [{"question": f"What is {material}? ({i})", "answer": material} for i in range(k)] for k in (1, 2, 3)})


def question_levels(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "entities").select("id", "title")
    return G.question_levels(rows, "id", "title", lambda: Scripted("questions", _levels), delay=0)


def _report(material: str) -> str:
    named, linked = material.split("\n\nRELATIONSHIPS:\n")
    lines = named.splitlines()[1:]
    if not linked:
        raise ValueError("nothing to say")
    title = lines[0][2:].rsplit(" (", 1)[0] if "\n" not in lines[0] else ""
    return fenced({"title": "Around " + title, "summary": f"{len(lines)} listed", "findings": ["a", "b", "c"], "importance_rating": float(len(linked.splitlines())), "rating_explanation": "by relations"})


def model_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Reports of the letters' communities; those without relations get the fixed report."""
    entities = _members(spark, folder).select("community", "title", F.lit("X").alias("entity_type"), F.lit("d").alias("description"), "degree")
    relations = _inside(spark, folder).select("community", "source", "target", F.lit("r").alias("description"), "weight").where("community < 'M'")
    return G.model_reports(entities, relations, lambda: Scripted("reports", _report), delay=0).select("community", "title", "summary", F.element_at("findings", 1).alias("first_finding"), "rank", "rating_explanation", "written")


def report_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """The fixed reports, where no model can be reached."""
    entities = _members(spark, folder).select("community", "title", "entity_type", "description", "degree")
    relations = _inside(spark, folder).select("community", "source", "target", "description", "weight")
    return G.model_reports(entities, relations, lambda: Scripted("unreachable", fail), delay=0).select("community", "title", "summary", "findings", "rank", "rating_explanation")


def long_summaries(spark: SparkSession, folder: str) -> DataFrame:
    return G.summaries(table(spark, folder, "documents"), "doc_id", "text", lambda: Scripted("summary", first_words(20)))


def name_descriptions(spark: SparkSession, folder: str) -> DataFrame:
    """The passage around the fifth word of each text of plain words, as a stand-in model repeats it."""
    plain = table(spark, folder, "documents").where(F.col("text").rlike(r"^[A-Za-z0-9 .,]{200,}$")).select("doc_id", "text", F.get(F.split("text", " "), F.lit(40)).alias("name")).where("name <> ''")
    return G.descriptions(plain, "doc_id", "name", "text", lambda: Scripted("echo", lambda m: m))


def _scores(material: str) -> str:
    out = []
    for chunk in json.loads(material):
        key = int(chunk["chunk_id"])
        if key % 7:
            out.append({"chunk_id": chunk["chunk_id"], "llm_relevance_score": "none" if key % 11 == 0 else str(len(chunk["text"]) % 10 / 10), "justification": "by length"})
    return fenced([*out, {"chunk_id": "-1", "llm_relevance_score": "1", "justification": "unknown"}])


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").where("text IS NOT NULL").select(F.col("source").alias("query_id"), F.col("doc_id").alias("chunk_id"), "text", ((F.col("doc_id") % 97) / 100.0).alias("relevance"))
    return top_per_group(rows, ["query_id"], [F.desc("relevance"), F.col("chunk_id")], 40).drop("rank")


def chunk_rerank(spark: SparkSession, folder: str) -> DataFrame:
    """Forty candidates of each source in batches of 15; some scores are no numbers, some chunks are left out, one is unknown."""
    found = G.rerank(_candidates(spark, folder), "?", lambda: Scripted("scores", _scores), delay=0)
    return found.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"), "justification")


def chunk_rerank_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """The same candidates by relevance, as no batch succeeds."""
    found = G.rerank(_candidates(spark, folder), "?", lambda: Scripted("unreachable", fail), delay=0)
    return found.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


class HalfJudge:
    """A fallback that gives half to every answer, and fails without one."""

    name = "half"

    def score(self, metric: str, question: str, answer: str, expected: str, context: str) -> float:
        if answer is None:
            raise ValueError("no answer")
        return 0.5


def judged_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Scores and flags of three metrics after retries and fallback."""
    attempts = G.judged(table(spark, folder, "metric_records"), "record_id", OverlapJudge, HalfJudge, delay=0, fallback_delay=0)
    return EV.resolve_attempts(attempts).withColumn("score", F.round("score", 6))


def judge_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """How often each model was asked."""
    attempts = G.judged(table(spark, folder, "metric_records"), "record_id", OverlapJudge, HalfJudge, delay=0, fallback_delay=0)
    return attempts.groupBy("metric", "model").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("score").isNull()).alias("failed"))


QUERIES = {
    f.__name__: f
    for f in (chunk_titles, model_answers, model_triplets, discovered_types, question_levels, model_reports, report_fallback, long_summaries, name_descriptions, chunk_rerank, chunk_rerank_fallback,
              judged_metrics, judge_attempts)
}

_W = "list_filter(regexp_split_to_array({0}, '[ \\t\\n\\r\\f]+'), lambda w: w <> '')"
_TERMS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"
_C = "c AS (SELECT * FROM (SELECT source AS query_id, doc_id AS chunk_id, text, (doc_id % 97) / 100.0::DOUBLE AS relevance, row_number() OVER (PARTITION BY source ORDER BY doc_id % 97 DESC, doc_id) AS k FROM documents WHERE text IS NOT NULL) WHERE k <= 40)"
_M = "m AS (SELECT *, left(title, 1) AS community FROM entities)"
_E = "kn AS (SELECT * FROM (SELECT id, left(title, 1) AS c, title, upper(trim(title)) AS t, row_number() OVER (PARTITION BY upper(trim(title)) ORDER BY human_readable_id, id) AS o FROM entities) WHERE o = 1), e AS (SELECT a.c AS community FROM relationships r JOIN kn a ON a.t = upper(trim(source_title)) JOIN kn b ON b.t = upper(trim(target_title)) WHERE a.c = b.c)"
_JUDGE = f"""s AS (SELECT record_id, unnest([struct_pack(metric := 'relevancy', w := query, g := actual_output), struct_pack(metric := 'precision', w := expected_output, g := actual_output), struct_pack(metric := 'recall', w := expected_output, g := retrieval_context)]) AS x, actual_output FROM metric_records),
j AS (SELECT record_id, x.metric AS metric, actual_output, CASE WHEN length(x.w) > 0 AND length(x.g) > 0 THEN len(list_intersect({_TERMS.format('x.w')}, {_TERMS.format('x.g')})) / CAST(greatest(1, len({_TERMS.format('x.w')})) AS DOUBLE) END AS p FROM s)"""

SQL = {
    "chunk_titles": f"""WITH t AS (SELECT doc_id, {_W.format('text')} AS w FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, w, CAST(unnest(range(0, CAST(greatest(0, ceil((len(w) - 400) / 393.0)) AS BIGINT) + 1)) AS INTEGER) AS pos FROM t WHERE len(w) > 0)
        SELECT row_number() OVER (ORDER BY doc_id, pos) AS id, doc_id, pos, array_to_string(w[pos * 393 + 1 : least(pos * 393 + 8, pos * 393 + 400)], ' ') AS title FROM p""",
    "model_answers": "SELECT record_id, CASE WHEN length(retrieval_context) > 0 THEN string_split(retrieval_context, '. ')[1] ELSE 'Error: ValueError: no context' END AS answer, 'first' AS model, CAST(1 AS INTEGER) AS tries, true AS adds_up FROM metric_records",
    "model_triplets": "SELECT id, trim(source_title) AS head, upper(trim(relation_type)) AS type, trim(target_title) AS tail FROM relationships WHERE upper(trim(relation_type)) IN ('ORBITS', 'PART_OF', 'STUDIED_BY') AND trim(source_title) <> '' AND trim(target_title) <> ''",
    "discovered_types": "SELECT list_sort(list_distinct(list_append(list(upper(trim(entity_type))), 'UNKNOWN'))) AS kinds FROM entities WHERE trim(entity_type) <> ''",
    "question_levels": "SELECT id, 'level_' || k AS qa_level, CAST(i AS INTEGER) AS pos, 'What is ' || title || '? (' || i || ')' AS question, title AS answer FROM (SELECT id, title, k, unnest(range(0, k)) AS i FROM (SELECT id, title, unnest([1, 2, 3]) AS k FROM entities))",
    "model_reports": f"""WITH {_M}, {_E}, r AS (SELECT community, count(*) AS r FROM e WHERE community < 'M' GROUP BY community), n AS (SELECT community, count(*) AS n FROM m GROUP BY community), t AS (SELECT community, title FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY degree DESC NULLS LAST, title) AS k FROM m) WHERE k = 1)
        SELECT community, CASE WHEN r > 0 THEN 'Around ' || title ELSE 'Community ' || community END AS title, CASE WHEN r > 0 THEN least(n, 20) || ' listed' ELSE 'This community contains ' || n || ' entities and ' || coalesce(r, 0) || ' relationships.' END AS summary,
        CASE WHEN r > 0 THEN 'a' ELSE 'Contains multiple related entities' END AS first_finding, CASE WHEN r > 0 THEN CAST(least(r, 20) AS DOUBLE) ELSE 5.0::DOUBLE END AS rank, CASE WHEN r > 0 THEN 'by relations' ELSE 'Medium importance based on limited analysis' END AS rating_explanation, coalesce(r, 0) > 0 AS written
        FROM n JOIN t USING (community) LEFT JOIN r USING (community)""",
    "report_fallback": f"""WITH {_M}, {_E} SELECT community, 'Community ' || community AS title, 'This community contains ' || count(*) || ' entities and ' || coalesce(any_value(r), 0) || ' relationships.' AS summary,
        ['Contains multiple related entities', 'Shows interconnected relationships', 'May represent a key topic area'] AS findings, 5.0::DOUBLE AS rank, 'Medium importance based on limited analysis' AS rating_explanation FROM m LEFT JOIN (SELECT community, count(*) AS r FROM e GROUP BY community) USING (community) GROUP BY community""",
    "long_summaries": f"SELECT doc_id, CASE WHEN len({_W.format('text')}) > 300 THEN array_to_string({_W.format('text')}[1:20], ' ') ELSE text END AS summary FROM documents",
    "chunk_rerank": f"""WITH {_C}, s AS (SELECT query_id, chunk_id, CASE WHEN chunk_id % 11 = 0 THEN 0 ELSE (least(length(text), 1500) % 10) / 10.0::DOUBLE END AS score FROM c WHERE chunk_id % 7 <> 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score > 0.1::DOUBLE) SELECT query_id, chunk_id, rank, round(score, 6) AS score, 'by length' AS justification FROM r WHERE rank <= 15""",
    "chunk_rerank_fallback": f"WITH {_C}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, chunk_id) AS rank FROM c WHERE relevance > 0.1::DOUBLE) SELECT query_id, chunk_id, rank, round(relevance, 6) AS score FROM r WHERE rank <= 15",
    "judged_metrics": f"WITH {_JUDGE} SELECT record_id, metric, round(coalesce(p, CASE WHEN actual_output IS NOT NULL THEN 0.5::DOUBLE END), 6) AS score, p IS NULL AND actual_output IS NOT NULL AS fallback_used_and_succeeded, p IS NULL AND actual_output IS NULL AS final_state_failed FROM j",
    "judge_attempts": f"""WITH {_JUDGE}, a AS (SELECT metric, 'primary' AS model, CASE WHEN p IS NULL THEN 4 ELSE 1 END AS n, CASE WHEN p IS NULL THEN 4 ELSE 0 END AS f FROM j UNION ALL SELECT metric, 'fallback', CASE WHEN actual_output IS NULL THEN 3 ELSE 1 END, CASE WHEN actual_output IS NULL THEN 3 ELSE 0 END FROM j WHERE p IS NULL)
        SELECT metric, model, CAST(sum(n) AS BIGINT) AS attempts, CAST(sum(f) AS BIGINT) AS failed FROM a GROUP BY metric, model""",
}

"""Operators whose values a model writes: prompts as columns, retries and fallbacks in Arrow batches, parsing as columns."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from skein.functions.text import fenced_json, whole_words, word_count
from skein.operators.chunking import numbered
from skein.operators.retrieval import top_per_group
from skein.providers import MARK, Generator, Judge

REPLY = T.StructType([
    T.StructField("answer", T.StringType()), T.StructField("model", T.StringType()), T.StructField("tries", T.IntegerType()), T.StructField("error", T.StringType()),
    T.StructField("prompt_tokens", T.IntegerType()), T.StructField("completion_tokens", T.IntegerType()), T.StructField("total_tokens", T.IntegerType()), T.StructField("time_taken", T.DoubleType()),
])


def _say(model: Generator, prompt: str, tries: int, delay: float, accept: Callable[[str], object] | None) -> tuple:
    """answer, model, tries, error, tokens, seconds of one prompt; the wait doubles after every failed try."""
    began, error = time.perf_counter(), None
    for attempt in range(1, tries + 1):
        try:
            reply = model.generate(prompt)
            if accept is not None:
                accept(reply.text)
            used = reply.prompt_tokens, reply.completion_tokens
            return reply.text, model.name, attempt, None, *used, sum(used), time.perf_counter() - began
        except Exception as failed:  # whatever a provider raises is a failed try
            error = f"{type(failed).__name__}: {failed}"
            if attempt < tries and delay:
                time.sleep(delay * 2 ** (attempt - 1))
    return None, model.name, tries, error, 0, 0, 0, time.perf_counter() - began


def complete(rows: DataFrame, keys: list[str], prompt: Column, maker: Callable[[], Generator], fallback: Callable[[], Generator] | None = None, tries: int = 4, delay: float = 4.0, accept: Callable[[str], object] | None = None) -> DataFrame:
    """keys and the columns of :data:`REPLY`: what the model says to each row's prompt.

    A try fails if the model raises or ``accept`` raises on its text. After ``tries`` failures the fallback model gets as
    many; if that fails too, the answer is null and the error is kept. A null prompt gives a null answer without a try.
    """
    schema = T.StructType([*rows.select(*keys).schema, *REPLY])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, first, second = to_arrow_schema(REPLY), maker(), fallback() if fallback is not None else None
        for batch in batches:
            out = []
            for text in batch.column(len(keys)).to_pylist():
                if text is None:
                    out.append((None, None, 0, None, 0, 0, 0, 0.0))
                    continue
                said = _say(first, text, tries, delay, accept)
                out.append(_say(second, text, tries, delay, accept) if said[0] is None and second is not None else said)
            columns = list(zip(*out)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *(pa.array(c, f.type) for c, f in zip(columns, kinds))], names=schema.names)

    return rows.select(*keys, prompt.alias("_prompt")).mapInArrow(run, schema)


def _about(instruction: str, material: Column) -> Column:
    return F.concat(F.lit(instruction + MARK), material)


def answers(rows: DataFrame, key: str, maker: Callable[[], Generator], question: str = "question", context: str = "context") -> DataFrame:
    """key and :data:`REPLY`: an answer to each question from its context. Where the model fails the answer is the error."""
    material = F.to_json(F.struct(F.coalesce(question, F.lit("")).alias("question"), F.coalesce(context, F.lit("")).alias("context")))
    found = complete(rows, [key], _about("Answer the question from the context alone.", material), maker, tries=1)
    return found.withColumn("answer", F.coalesce("answer", F.concat(F.lit("Error: "), "error")))


def titles(chunks: DataFrame, order: list[str], text: str, maker: Callable[[], Generator], tries: int = 4, delay: float = 4.0) -> DataFrame:
    """id (1..n in the order), the order, title, text: chunks with the title that the model gives each; "" where it fails."""
    said = complete(chunks, order, _about("Give this text a short title.", F.coalesce(text, F.lit(""))), maker, tries=tries, delay=delay)
    named = chunks.select(*order, text).join(said.select(*order, F.coalesce("answer", F.lit("")).alias("title")), order)
    return numbered(named, order, "id").select((F.col("id") + 1).alias("id"), *order, "title", text)


TRIPLETS = "array<struct<head:string,type:string,tail:string>>"


def _is_json(text: str) -> None:
    import json
    import re

    json.loads(re.search(r"```json\s*(.*?)\s*```", text, re.S).group(1))


def model_triplets(chunks: DataFrame, key: str, text: str, kinds: list[str], maker: Callable[[], Generator], tries: int = 4, delay: float = 4.0) -> DataFrame:
    """key, pos, head, type, tail: triplets that the model finds in each chunk, of the allowed types only.

    The reply must be fenced JSON; a chunk whose every try fails gives no row, and neither do parts without a head or tail.
    """
    instruction = "List the relations in this text as JSON in a fence, with head, type and tail. Types: " + ", ".join(kinds)
    said = complete(chunks, [key], _about(instruction, F.col(text)), maker, tries=tries, delay=delay, accept=_is_json)
    parts = said.select(key, F.posexplode(F.from_json(fenced_json(F.col("answer")), TRIPLETS)).alias("pos", "t")).select(key, "pos", *(F.trim(f"t.{c}").alias(c) for c in ("head", "type", "tail")))
    return parts.where(F.col("type").isin(kinds) & (F.col("head") != "") & (F.col("tail") != ""))


def with_unknown(kinds: Column) -> Column:
    """The distinct types and UNKNOWN, sorted."""
    return F.array_sort(F.array_distinct(F.array_union(F.coalesce(kinds, F.array().cast("array<string>")), F.array(F.lit("UNKNOWN")))))


def discovered_types(samples: DataFrame, key: str, text: str, maker: Callable[[], Generator], tries: int = 4, delay: float = 4.0) -> DataFrame:
    """One row ``kinds``: the types that the model names in the sampled chunks, upper case, with UNKNOWN, sorted.

    The types are distinct before they meet; there are as many as the domain has, not as the sample has chunks.
    """
    said = complete(samples, [key], _about("Name the types of things in this text as a JSON list in a fence.", F.col(text)), maker, tries=tries, delay=delay, accept=_is_json)
    named = said.select(F.explode(F.from_json(fenced_json(F.col("answer")), "array<string>")).alias("kind")).select(F.upper(F.trim("kind")).alias("kind")).where("kind <> ''").distinct()
    return named.agg(with_unknown(F.collect_set("kind")).alias("kinds"))


QUESTIONS = "map<string,array<struct<question:string,answer:string>>>"


def question_levels(batches: DataFrame, key: str, text: str, maker: Callable[[], Generator], tries: int = 3, delay: float = 4.0) -> DataFrame:
    """key, qa_level, pos, question, answer: pairs of three levels that the model writes about each batch of chunks."""
    said = complete(batches, [key], _about("Write questions and answers of level_1, level_2 and level_3 on this text, as one JSON object in a fence.", F.col(text)), maker, tries=tries, delay=delay, accept=_is_json)
    levels = said.select(key, F.explode(F.from_json(fenced_json(F.col("answer")), QUESTIONS)).alias("qa_level", "pairs"))
    return levels.select(key, "qa_level", F.posexplode("pairs").alias("pos", "pair")).select(key, "qa_level", "pos", "pair.question", "pair.answer")


REPORT = "title string, summary string, findings array<string>, importance_rating double, rating_explanation string"
# The report of a community for which the model fails.
NO_FINDINGS = ("Contains multiple related entities", "Shows interconnected relationships", "May represent a key topic area")
NO_RATING, NO_EXPLANATION = 5.0, "Medium importance based on limited analysis"
#: Entities and relations of a community that a prompt holds.
IN_PROMPT = 20


def _listed(rows: DataFrame, order: list, line: Column, name: str) -> DataFrame:
    """community and the lines of its first ``IN_PROMPT`` rows; Spark limits each community before it shuffles."""
    best = top_per_group(rows, ["community"], order, IN_PROMPT).withColumn("_line", line)
    return best.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_line"))), lambda s: s["_line"]), "\n").alias(name))


def model_reports(entities: DataFrame, relations: DataFrame, maker: Callable[[], Generator], tries: int = 5, delay: float = 5.0) -> DataFrame:
    """community, title, summary, findings, rank, rating_explanation, written (whether the model wrote it).

    Input as for :func:`skein.operators.communities.reports`. A community for which every try fails gets the fixed report
    with its numbers of entities and relations.
    """
    sizes = entities.groupBy("community").agg(F.count(F.lit(1)).alias("n")).join(relations.groupBy("community").agg(F.count(F.lit(1)).alias("r")), "community", "left")
    blank = lambda c: F.coalesce(c, F.lit(""))
    named = _listed(entities, [F.desc_nulls_last("degree"), F.col("title")], F.concat(F.lit("- "), "title", F.lit(" ("), blank("entity_type"), F.lit("): "), blank("description")), "named")
    linked = _listed(relations, [F.desc_nulls_last("weight"), F.col("source"), F.col("target"), F.col("description")], F.concat(F.lit("- "), "source", F.lit(" → "), "target", F.lit(": "), blank("description")), "linked")
    rows = sizes.join(named, "community").join(linked, "community", "left")
    material = F.concat(F.lit("ENTITIES:\n"), "named", F.lit("\n\nRELATIONSHIPS:\n"), blank("linked"))
    said = complete(rows, ["community"], _about("Describe this community as JSON in a fence: title, summary, three findings, importance_rating from 1 to 10, rating_explanation.", material), maker, tries=tries, delay=delay, accept=_is_json)
    parsed = said.select("community", F.from_json(fenced_json(F.col("answer")), REPORT).alias("a"))
    counts = F.concat(F.lit("This community contains "), F.col("n").cast("string"), F.lit(" entities and "), F.coalesce("r", F.lit(0)).cast("string"), F.lit(" relationships."))
    return rows.join(parsed, "community").select(
        "community", F.coalesce("a.title", F.concat(F.lit("Community "), F.col("community").cast("string"))).alias("title"), F.coalesce("a.summary", counts).alias("summary"),
        F.coalesce("a.findings", F.array(*map(F.lit, NO_FINDINGS))).alias("findings"), F.coalesce("a.importance_rating", F.lit(NO_RATING)).alias("rank"),
        F.coalesce("a.rating_explanation", F.lit(NO_EXPLANATION)).alias("rating_explanation"), F.col("a").isNotNull().alias("written"),
    )


def summaries(rows: DataFrame, key: str, text: str, maker: Callable[[], Generator], above: int = 300, tries: int = 1) -> DataFrame:
    """key, summary: texts of more than ``above`` words in the model's words, others as they are; so too where it fails."""
    long = F.when(word_count(F.col(text)) > above, F.col(text))
    said = complete(rows, [key], _about("Summarise this text.", long), maker, tries=tries, delay=0)
    return rows.select(key, text).join(said.select(key, "answer"), key, "left").select(key, F.coalesce("answer", text).alias("summary"))


def descriptions(names: DataFrame, key: str, name: str, text: str, maker: Callable[[], Generator], width: int = 100) -> DataFrame:
    """key, description: what the model says of each name within ``width`` characters on both sides; null if it does not occur."""
    from skein.functions.text import around

    context = around(F.col(text), F.col(name), width)
    said = complete(names, [key], _about("Describe the name in this passage.", context), maker, tries=1, delay=0)
    return said.select(key, F.col("answer").alias("description"))


SCORES = "array<struct<chunk_id:string,llm_relevance_score:string,justification:string>>"
# Fixed value: the justification of a score that no model gave.
UNSCORED = "Fallback - LLM processing failed for batch."


def rerank(chunks: DataFrame, query: str, maker: Callable[[], Generator], batch: int = 15, k: int = 15, above: float = 0.1, tries: int = 3, delay: float = 2.0) -> DataFrame:
    """query_id, chunk_id, score, justification, rank: the ``k`` chunks of each query that the model scores highest.

    ``chunks`` has query_id, chunk_id, text (cut to 1,500 characters for the prompt) and relevance, a bounded candidate list
    for each query. They go to the model in batches by relevance. A score that is no number counts 0, an id that is not in
    the batch is dropped, a chunk that the reply leaves out is too, and a batch whose every try fails keeps its relevance.
    """
    placed = top_per_group(chunks, ["query_id"], [F.desc_nulls_last("relevance"), F.col("chunk_id")], 1 << 30).withColumn("_batch", F.floor((F.col("rank") - 1) / batch))
    payload = F.to_json(F.sort_array(F.collect_list(F.struct("rank", F.col("chunk_id").cast("string").alias("chunk_id"), F.substring("text", 1, 1500).alias("text")))))
    groups = placed.groupBy("query_id", "_batch").agg(payload.alias("_payload"))
    said = complete(groups, ["query_id", "_batch"], _about(f"Score each chunk from 0 to 1 for this query, as a JSON list of chunk_id, llm_relevance_score and justification in a fence. Query: {query}", F.col("_payload")), maker, tries=tries, delay=delay, accept=_is_json)
    given = said.select("query_id", "_batch", F.inline(F.from_json(fenced_json(F.col("answer")), SCORES))).groupBy("query_id", "_batch", F.col("chunk_id").alias("_id")).agg(F.min(F.struct(F.coalesce(F.expr("try_cast(llm_relevance_score AS DOUBLE)"), F.lit(0.0)).alias("s"), F.coalesce("justification", F.lit("")).alias("j"))).alias("g"))
    known = placed.join(said.select("query_id", "_batch", F.col("answer").isNotNull().alias("_said")), ["query_id", "_batch"]).withColumn("_id", F.col("chunk_id").cast("string"))
    scored = known.join(given, ["query_id", "_batch", "_id"], "left").where(~F.col("_said") | F.col("g").isNotNull())
    out = scored.select("query_id", "chunk_id", F.when(F.col("_said"), F.col("g.s")).otherwise(F.coalesce("relevance", F.lit(0.0))).alias("score"), F.when(F.col("_said"), F.col("g.j")).otherwise(UNSCORED).alias("justification"))
    return top_per_group(out.where(F.col("score") > above), ["query_id"], [F.desc("score"), F.col("chunk_id")], k)


METRICS = ("relevancy", "precision", "recall")


def judged(records: DataFrame, key: str, primary: Callable[[], Judge], fallback: Callable[[], Judge] | None, tries: int = 4, fallback_tries: int = 3, delay: float = 5.0, fallback_delay: float = 7.0) -> DataFrame:
    """key, metric, model, attempt, score: every attempt at every metric, as :func:`skein.operators.evaluation.resolve_attempts` takes them.

    Input has query, actual_output, expected_output and retrieval_context. A failed attempt has a null score. The fallback
    judges what the primary failed at, unless it is the same model.
    """
    schema = T.StructType([*records.select(F.col(key).alias("record_id")).schema, *(T.StructField(c, t) for c, t in (("metric", T.StringType()), ("model", T.StringType()), ("attempt", T.IntegerType()), ("score", T.DoubleType())))])

    def attempts(judge: Judge, role: str, metric: str, sides: tuple, most: int, wait: float) -> list[tuple]:
        out = []
        for attempt in range(1, most + 1):
            try:
                return [*out, (metric, role, attempt, float(judge.score(metric, *sides)))]
            except Exception:  # whatever a judge raises is a failed attempt
                out.append((metric, role, attempt, None))
                if attempt < most and wait:
                    time.sleep(wait)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = primary(), fallback() if fallback is not None else None
        kinds = to_arrow_schema(schema)
        for batch in batches:
            out = []
            for record, *sides in zip(*(c.to_pylist() for c in batch.columns)):
                for metric in METRICS:
                    done = attempts(first, "primary", metric, tuple(sides), tries, delay)
                    if done[-1][3] is None and second is not None and second.name != first.name:
                        done += attempts(second, "fallback", metric, tuple(sides), fallback_tries, fallback_delay)
                    out += [(record, *d) for d in done]
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], names=schema.names)

    return records.select(key, "query", "actual_output", "expected_output", "retrieval_context").mapInArrow(run, schema)


def preview(text: Column, limit: int = 30) -> Column:
    """The start of a title for a log, cut to whole words."""
    return whole_words(text, limit)

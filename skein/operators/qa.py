"""Question sets: flattening, validity, removal of repeats, evaluation objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import is_blank
from skein.operators.retrieval import first_wins

NESTED = "map<string,array<struct<question:string,answer:string>>>"


def flatten(rows: DataFrame, text: str) -> DataFrame:
    """qa_level, pos, question, answer of JSON objects level -> list of pairs; broken JSON gives no row."""
    levels = rows.select(F.explode(F.from_json(text, NESTED)).alias("qa_level", "pairs"))
    return levels.select("qa_level", F.posexplode("pairs").alias("pos", "pair")).select("qa_level", "pos", "pair.question", "pair.answer")


def valid(pairs: DataFrame) -> DataFrame:
    """Pairs with a question and an answer that are not blank."""
    return pairs.where(~is_blank(F.col("question")) & ~is_blank(F.col("answer")))


def without_repeats(pairs: DataFrame, order: list[str]) -> DataFrame:
    """The first pair of each question inside its level."""
    return first_wins(pairs, ["qa_level", "question"], [F.col(c) for c in order]).select(*pairs.columns)


def evaluation_objects(answers: DataFrame) -> DataFrame:
    """Answers with total time (retrieval plus model), total tokens and the context as a list of one."""
    return answers.withColumns({
        "time_taken": F.coalesce("retrieval_time", F.lit(0.0)) + F.coalesce("llm_time", F.lit(0.0)),
        "total_tokens": F.coalesce("num_input_token", F.lit(0)) + F.coalesce("num_output_token", F.lit(0)),
        "retrieval_context": F.array("retrieval_context"),
    })


STRATEGIES = ("dense", "sparse", "hybrid", "DL_local", "DL_drift", "DL_global", "LLM_local", "LLM_drift", "LLM_global")


def fan_out(questions: DataFrame) -> DataFrame:
    """Every question with each of the nine strategies."""
    return questions.withColumn("search_type", F.explode(F.array(*map(F.lit, STRATEGIES))))

"""Scores of answers, their fallbacks and roll-ups."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from skein.functions.text import terms
from skein.operators.chunking import numbered


@F.pandas_udf(DoubleType())
def rouge1(answer: pd.Series, expected: pd.Series) -> pd.Series:
    """F1 of the multiset overlap of terms, without stemming; 0 if either side has none or is null. Linear in the terms."""
    split = re.compile("[a-z0-9]+").findall
    out = []
    for a, b in zip(answer, expected):
        x, y = Counter(split((a or "").lower())), Counter(split((b or "").lower()))
        size = x.total() + y.total()
        out.append(2.0 * (x & y).total() / size if x and y else 0.0)
    return pd.Series(out, dtype="float64")


def relevancy_verdicts(answer: Column, question: Column, letters: int = 4) -> Column:
    """1 for each sentence of the answer that shares a term of some length with the question, else 0; null without an answer."""
    long = F.filter(terms(question), lambda t: F.length(t) >= letters)
    return F.transform(F.split(answer, r"\. "), lambda s: F.when(F.size(F.array_intersect(terms(s), long)) > 0, 1).otherwise(0))


def ranked_precision(verdicts: Column) -> Column:
    """Mean over the relevant ranks of the precision up to each; ``verdicts`` is an array of 0 and 1; 0 if none is 1."""
    step = F.aggregate(
        F.transform(verdicts, lambda v, i: F.struct(v.cast("double").alias("v"), (i + 1).cast("double").alias("k"))),
        F.struct(F.lit(0.0).alias("hits"), F.lit(0.0).alias("sum")),
        lambda s, x: F.struct((s["hits"] + x["v"]).alias("hits"), (s["sum"] + x["v"] * (s["hits"] + x["v"]) / x["k"]).alias("sum")),
        lambda s: F.when(s["hits"] > 0, s["sum"] / s["hits"]).otherwise(0.0),
    )
    return F.coalesce(step, F.lit(0.0))


def share(verdicts: Column) -> Column:
    """Mean of an array of 0 and 1; null for an empty or null array."""
    return F.when(F.size(verdicts) > 0, F.aggregate(verdicts, F.lit(0.0), lambda s, v: s + v.cast("double")) / F.size(verdicts))


def context_verdicts(context: Column, expected: Column, shared_terms: int = 3) -> Column:
    """1 for each sentence of the context that shares enough terms with the expected answer, else 0; the offline judge."""
    wanted = terms(expected)
    return F.transform(F.split(context, r"\. "), lambda s: F.when(F.size(F.array_intersect(terms(s), wanted)) >= shared_terms, 1).otherwise(0))


def resolve_attempts(attempts: DataFrame) -> DataFrame:
    """record_id, metric, score, fallback_used_and_succeeded, final_state_failed from (record_id, metric, model, attempt, score).

    A null score is a failed attempt. The first primary score counts, else the first of the fallback; without any the
    metric failed.
    """
    good = F.col("score").isNotNull()
    order = lambda model: F.min_by("score", F.when(good & (F.col("model") == model), F.col("attempt")))
    found = attempts.groupBy("record_id", "metric").agg(order("primary").alias("p"), order("fallback").alias("f"), F.bool_or(good & (F.col("model") == "primary")).alias("hp"), F.bool_or(good & (F.col("model") == "fallback")).alias("hf"))
    return found.select("record_id", "metric", F.when(F.col("hp"), F.col("p")).when(F.col("hf"), F.col("f")).alias("score"), (~F.col("hp") & F.col("hf")).alias("fallback_used_and_succeeded"), (~F.col("hp") & ~F.col("hf")).alias("final_state_failed"))


def with_timestamps(records: DataFrame, order: list[str], start: str) -> DataFrame:
    """created_at = start plus one second for each record before it in the order."""
    rows = numbered(records, order, "_n")
    return rows.withColumn("created_at", F.timestamp_add("SECOND", F.col("_n").cast("int"), F.to_timestamp_ntz(F.lit(start)))).drop("_n")


def rollup(records: DataFrame, keys: list[str], scores: list[str]) -> DataFrame:
    """Records and mean of each score (a missing one is 0) for each group; pre-aggregated before the shuffle."""
    return records.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"), *(F.round(F.avg(F.coalesce(s, F.lit(0.0))), 6).alias(s) for s in scores))

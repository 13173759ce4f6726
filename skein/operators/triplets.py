"""Parsing what models wrote: linearised triplets and typed mentions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from skein.functions.fuzzy import sequence_ratio

GENERIC = "REBEL_ENTITY"
MARKS = r"<s>|</s>|<pad>"


def parse_linear(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, head, type, tail of ``<triplet> head <subj> tail <obj> relation`` texts.

    One head may carry several ``<subj> tail <obj> relation`` parts. Parts without head, tail or relation are dropped.
    Splitting at the marks gives the parts; no state is kept between rows.
    """
    clean = F.trim(F.regexp_replace(F.col(text), MARKS, ""))
    heads = rows.select(key, F.posexplode(F.slice(F.split(clean, "<triplet>"), 2, 1 << 30)).alias("h", "part"))
    tails = heads.select(key, "h", F.split("part", "<subj>").alias("p")).select(
        key, "h", F.trim(F.element_at("p", 1)).alias("head"), F.posexplode(F.slice("p", 2, 1 << 30)).alias("t", "rest")
    )
    cut = tails.withColumn("rest", F.split("rest", "<obj>"))
    found = cut.select(key, "h", "t", "head", F.trim(F.get("rest", F.lit(1))).alias("type"), F.trim(F.get("rest", F.lit(0))).alias("tail"))
    return found.where("head <> '' AND type <> '' AND tail <> ''").select(key, "h", "t", *(F.regexp_replace(c, r"\s+", " ").alias(c) for c in ("head", "type", "tail")))


def score_weight(log_score: Column) -> Column:
    """Weight of a generated triplet: exp of its score within [0, 1], two places."""
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(log_score))), 2)


def mention_types(names: DataFrame, found: DataFrame, scope: str, threshold: float = 0.60) -> DataFrame:
    """scope, name, type: the type of the recognised word (scope, pos, word, kind) that is the name, else most like it.

    Exact matches come first, then the highest ratio of at least ``threshold``, then the position; without any, GENERIC.
    Names meet only the words of their own scope (one sentence).
    """
    near = names.join(found, scope).withColumn("ratio", F.when(F.trim("word") == F.trim("name"), 2.0).otherwise(sequence_ratio(F.trim("word"), F.trim("name"))))
    best = near.where((F.col("ratio") >= threshold) & F.col("kind").isNotNull()).groupBy(scope, "name").agg(F.min_by("kind", F.struct(-F.col("ratio"), F.col("pos"))).alias("kind"))
    return names.select(scope, "name").distinct().join(best, [scope, "name"], "left").select(scope, "name", F.coalesce("kind", F.lit(GENERIC)).alias("type"))


def regular_triplets(rows: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """key, pos, head, type, tail: what a pattern with three groups finds in each text; the offline extractor."""
    schema = rows.select(key).schema.add("pos", IntegerType()).add("head", "string").add("type", "string").add("tail", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        find = re.compile(pattern).finditer
        for batch in batches:
            out = [(k, i, *m.groups()) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for i, m in enumerate(find(t))]
            columns = list(zip(*out)) if out else [[]] * 5
            types = (batch.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[key, "pos", "head", "type", "tail"])

    return rows.select(key, text).mapInArrow(run, schema)

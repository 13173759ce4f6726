"""Reading pages, question sets and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE = T.StructType([T.StructField(n, T.StringType()) for n in ("chunk", "url", "timestamp", "_corrupt_record")])


def page_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """chunk, url, crawled_at of JSON lists of pages, or of one page a line; broken files and rows are left out."""
    rows = spark.read.schema(PAGE).option("multiLine", not lines).option("mode", "PERMISSIVE").json(path)
    good = rows.where(F.col("_corrupt_record").isNull() & F.col("chunk").isNotNull())
    return good.select("chunk", "url", F.try_to_timestamp("timestamp").alias("crawled_at"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole UTF-8 files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def question_json(spark: SparkSession, path: str) -> DataFrame:
    """qa_level, pos, question, answer of files that hold a JSON object level -> list of pairs."""
    from skein.operators.qa import flatten

    return flatten(whole_texts(spark, path), "text")

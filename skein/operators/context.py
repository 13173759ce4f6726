"""Text contexts put together from ranked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined_lines(rows: DataFrame, group: list[str], order: list[str], line: Column, separator: str = "\n", name: str = "context") -> DataFrame:
    """group, context: the lines of each group in order. A group is a ranked, bounded selection, never a whole table."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, line.alias("_line"))))
    return rows.groupBy(*group).agg(ordered.alias("_l")).select(*group, F.array_join(F.transform("_l", lambda s: s["_line"]), separator).alias(name))


def vector_context(ranked: DataFrame, texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """query_id, context: ``title: ... text: ...`` blocks in rank order with a blank line between."""
    block = F.concat(F.lit("title: "), F.coalesce("title", F.lit("")), F.lit(" text: "), F.coalesce("text", F.lit("")))
    rows = ranked.join(texts.select(key, "title", "text"), key)
    return joined_lines(rows, ["query_id"], ["rank"], block, "\n\n")


def sections(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """One row with context and approx_token_count, from (heading, rows of ord and line) in order; an empty part is left out."""
    united = None
    for number, (heading, rows) in enumerate(parts):
        body = rows.select(F.lit(number).alias("section"), F.lit(1).alias("place"), F.col("ord").cast("long").alias("ord"), "line")
        head = body.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(number).alias("section"), F.lit(0).alias("place"), F.lit(0).cast("long").alias("ord"), F.lit(heading).alias("line"))
        both = head.unionByName(body)
        united = both if united is None else united.unionByName(both)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "place", "ord", "line"))), lambda s: s["line"]), "\n")
    return united.agg(text.alias("context")).withColumn("approx_token_count", F.size(F.filter(F.split("context", r"\s+"), lambda w: w != "")))

"""Queries of the training-data operators, over whole tables with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm import abuse, blocks, leakage, pairs, repeated_lines, residue, splitting, tokens

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _over(name: str, *more: str) -> Callable[[Callable[..., DataFrame]], Query]:
    def wrap(operator: Callable[..., DataFrame]) -> Query:
        return lambda spark, folder: operator(*(_table(spark, folder, n) for n in (name, *more)))

    return wrap


def _templates(records: DataFrame) -> DataFrame:
    return pairs.opening_templates(pairs.checkpoint(pairs.direct_checks(records)))


def _round_trip(pages: DataFrame) -> DataFrame:
    """page_id, digest, fits, overlaps: the pieces of each page put together again, and whether all keep size and overlap."""
    found = splitting.split_pages(pages)
    before = F.lag("piece").over(Window.partitionBy("page_id").orderBy("piece_no"))
    own = F.when(F.col("piece_no") == 0, F.col("piece")).otherwise(F.substr("piece", F.lit(splitting.OVERLAP + 1)))
    same = (F.col("piece_no") == 0) | (F.substring(before, -splitting.OVERLAP, splitting.OVERLAP) == F.substring("piece", 1, splitting.OVERLAP))
    rows = found.select("page_id", "piece_no", own.alias("own"), (F.length("piece") <= splitting.LIMIT).alias("fits"), same.alias("overlaps"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "own"))), lambda s: s["own"]), "")
    return rows.groupBy("page_id").agg(F.md5(joined).alias("digest"), F.bool_and("fits").alias("fits"), F.bool_and("overlaps").alias("overlaps"))


def queries() -> dict[str, Query]:
    pages, documents, records = _over("crawl_pages"), _over("documents"), _over("metric_records")
    leak, judged = _over("documents", "eval_items"), _over("documents", "doc_labels")
    return {
        "p1_found": pages(repeated_lines.repeated_occurrences),
        "p1_clean": pages(repeated_lines.remove_repeated),
        "p1_sequences": pages(repeated_lines.frequent_sequences),
        "p1_patterns": pages(repeated_lines.frequent_patterns),
        "p2_found": pages(blocks.boilerplate_lines),
        "p2_bodies": pages(blocks.main_bodies),
        "p3_found": records(pairs.broken_pairs),
        "p3_templates": records(_templates),
        "p4_found": pages(splitting.oversized),
        "p4_pieces": pages(splitting.split_pages),
        "p4_round_trip": pages(_round_trip),
        "p5_found": pages(lambda p: residue.residue_pages(p).select("page_id")),
        "p5_evidence": pages(residue.residual_evidence),
        "p5_kept": pages(lambda p: residue.keep_content(p).select("page_id")),
        "p6_ids": documents(tokens.encode_texts),
        "p7_found": leak(leakage.leaks),
        "p7_matches": leak(leakage.leaked_passages),
        "p7_clean": leak(lambda d, i: leakage.without_leaks(d, i).select("doc_id")),
        "p8_found": judged(abuse.bad_documents),
        "p8_scores": judged(lambda d, v: abuse.score_documents(d, v).withColumn("severity", F.round("severity", 4)).drop("p_bad")),
        "p8_sources": judged(abuse.source_rates),
    }


_LINES = r"""
lines AS (
  SELECT page_id, url, CAST(i - 1 AS INTEGER) AS line_no, parts[i] AS line,
         regexp_replace(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\.', '') AS site,
         trim(regexp_replace(lower(parts[i]), '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS same
  FROM (SELECT page_id, url, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT page_id, url, string_split(chunk, chr(10)) AS parts FROM crawl_pages WHERE url IS NOT NULL AND chunk IS NOT NULL)))
"""

_GRAMS = r"""
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE passage IS NOT NULL),
dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM d WHERE len(w) >= 12),
eg AS (SELECT DISTINCT item_id, g FROM (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM e WHERE len(w) >= 12))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_LINES}"
        r""", kept AS (SELECT site, same FROM lines WHERE regexp_matches(line, '\p{L}') GROUP BY site, same HAVING count(DISTINCT url) >= 8)
        SELECT page_id, line_no FROM lines SEMI JOIN kept USING (site, same) WHERE regexp_matches(line, '\p{L}')""",
        "p1_clean": f"WITH {_LINES}"
        r""", kept AS (SELECT site, same FROM lines WHERE regexp_matches(line, '\p{L}') GROUP BY site, same HAVING count(DISTINCT url) >= 8),
        gone AS (SELECT page_id, list(line_no) AS gone FROM lines SEMI JOIN kept USING (site, same) WHERE regexp_matches(line, '\p{L}') GROUP BY page_id)
        SELECT page_id, CASE WHEN gone IS NULL THEN chunk ELSE array_to_string(list_filter(string_split(chunk, chr(10)), lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END AS chunk FROM crawl_pages LEFT JOIN gone USING (page_id)""",
        "p4_found": "SELECT page_id FROM crawl_pages WHERE length(chunk) > 4000",
        "p7_found": f"WITH {_GRAMS} SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)",
        "p4_round_trip": "SELECT page_id, md5(chunk) AS digest, true AS fits, true AS overlaps FROM crawl_pages WHERE length(chunk) > 0",
        "p7_matches": r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
        e AS (SELECT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE passage IS NOT NULL),
        di AS (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d), dg AS (SELECT doc_id, i, array_to_string(w[i:i + 11], ' ') AS g FROM di),
        ei AS (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS j FROM e), eg AS (SELECT item_id, j, array_to_string(w[j:j + 11], ' ') AS g FROM ei),
        m AS (SELECT DISTINCT doc_id, item_id, i, i - j AS d FROM dg JOIN eg USING (g)),
        r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, d ORDER BY i) AS island FROM m),
        x AS (SELECT doc_id, item_id, CAST(min(i) - 1 AS INTEGER) AS first_word, CAST(count(*) + 11 AS INTEGER) AS n_words FROM r GROUP BY doc_id, item_id, d, island)
        SELECT doc_id, item_id, first_word, n_words FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_words DESC, first_word) AS k FROM x) WHERE k = 1""",
        "p7_clean": f"WITH {_GRAMS} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM dg JOIN eg USING (g))",
    }

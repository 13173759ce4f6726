"""Queries over texts: cleaning, chunking, identifiers, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import chunking
from skein.plans.tables import table


def html_to_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "crawl_pages").select("page_id", T.plain_text(F.col("chunk")).alias("plain"))


def skip_blank(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "crawl_pages").where(~T.is_blank(F.col("chunk"))).select("page_id", "url")


def token_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.token_windows(table(spark, folder, "documents"), "doc_id", "text").select("doc_id", "pos", "n_tokens", "chunk_id")


def text_units(spark: SparkSession, folder: str) -> DataFrame:
    """The same chunk text is one text unit, with the documents it comes from."""
    cut = chunking.token_windows(table(spark, folder, "documents"), "doc_id", "text")
    return cut.groupBy("chunk_id").agg(F.min("n_tokens").alias("n_tokens"), F.array_sort(F.collect_set("doc_id")).alias("document_ids"))


def sentence_split(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.sentence_rows(table(spark, folder, "documents"), "doc_id", "text").select("doc_id", "pos", F.length("sentence").alias("chars"))


def normalize_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "entities").select("id", T.normal_name(F.col("title")).alias("name"))


def trim_words(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    return table(spark, folder, "documents").select("doc_id", T.whole_words(text, 120).alias("head"), T.whole_words(text, 120, True).alias("tail"))


def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").groupBy("source").agg(F.sum(T.word_count(F.col("text"))).alias("n_tokens"), F.count(F.lit(1)).alias("documents"))


def stable_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", T.stable_id(F.col("text")).alias("id"))


def label_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "entities").select("id", T.label_name(F.col("entity_type")).alias("label"))


def readable_ids(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.numbered(table(spark, folder, "entities").select("id", "title"), ["title", "id"])


def qa_batches(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.batches(table(spark, folder, "documents").select("doc_id"), ["doc_id"], 34)


def site_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of each source in order, with where each starts in their concatenation with blank lines between."""
    return chunking.corpus_parts(table(spark, folder, "documents"), "source", "doc_id", "text").select("source", "doc_id", "start", "chars", F.md5("text").alias("digest"))


QUERIES = {f.__name__: f for f in (html_to_text, skip_blank, token_chunks, text_units, sentence_split, normalize_names, trim_words, token_counts, stable_ids, label_names, readable_ids, qa_batches, site_corpus)}

_WORDS = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda w: w <> '')"
_CUT = f"""
t AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, w, unnest(range(0, CAST(greatest(0, ceil((len(w) - 400) / 393.0)) AS BIGINT) + 1)) AS pos FROM t WHERE len(w) > 0),
c AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, w[pos * 393 + 1 : pos * 393 + 400] AS part FROM p),
x AS (SELECT doc_id, pos, CAST(len(part) AS INTEGER) AS n_tokens, sha256(array_to_string(part, ' ')) AS chunk_id FROM c)
"""
_BLANK = "coalesce(length(regexp_replace({0}, '[ \\t\\n\\r\\f]+', '', 'g')) = 0, true)"

SQL = {
    "html_to_text": r"""
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    chunk, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'),
    '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '(?m)^[ \t]*(?:#{1,6}|[-*+]|>)[ \t]+', '', 'g'), '\*\*|__|`', '', 'g'), '<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&#39;', ''''), '&quot;', '"'), '&gt;', '>'), '&lt;', '<'), '&amp;', '&'), '[ \t\n\r\f]+', ' ', 'g')) AS plain FROM crawl_pages""",
    "skip_blank": f"SELECT page_id, url FROM crawl_pages WHERE NOT {_BLANK.format('chunk')}",
    "token_chunks": f"WITH {_CUT} SELECT * FROM x",
    "text_units": f"WITH {_CUT} SELECT chunk_id, min(n_tokens) AS n_tokens, list_sort(list(DISTINCT doc_id)) AS document_ids FROM x GROUP BY chunk_id",
    "normalize_names": r"SELECT id, coalesce(regexp_replace(lower(trim(title)), '^(the|a|an|la|el|los|las)[ \t\n\r\f]+', ''), '') AS name FROM entities",
    "trim_words": r"""
SELECT doc_id,
  CASE WHEN length(text) <= 120 THEN text WHEN instr(left(text, 120), ' ') > 0 THEN regexp_replace(left(text, 120), '(?s) [^ ]*$', '') ELSE left(text, 120) END AS head,
  CASE WHEN length(text) <= 120 THEN text WHEN instr(right(text, 120), ' ') > 0 THEN substr(right(text, 120), instr(right(text, 120), ' ') + 1) ELSE right(text, 120) END AS tail
FROM documents""",
    "token_counts": f"SELECT source, CAST(sum(coalesce(len({_WORDS}), 0)) AS BIGINT) AS n_tokens, count(*) AS documents FROM documents GROUP BY source",
    "stable_ids": "SELECT doc_id, sha256(text) AS id FROM documents",
    "label_names": r"""SELECT id, CASE WHEN entity_type IS NOT NULL THEN array_to_string(list_transform(string_split(replace(replace(entity_type, '"', ''), '_', ' '), ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), '') END AS label FROM entities""",
    "readable_ids": "SELECT id, title, row_number() OVER (ORDER BY title, id) - 1 AS human_readable_id FROM entities",
    "qa_batches": "SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 34) AS BIGINT) AS batch FROM documents",
    "site_corpus": "SELECT source, doc_id, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(length(text) AS INTEGER) AS chars, md5(text) AS digest FROM documents WHERE text IS NOT NULL AND source IS NOT NULL",
}

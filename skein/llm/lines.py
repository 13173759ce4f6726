"""Pages as lines: site of a URL, normalised lines, and the URL support of each line within its site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of what Unicode or the control block counts as white space.
WHITE = r"(?U)[\s\x1c-\x1f]+"
HOST = r"^(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)"


def site_of(url: Column) -> Column:
    """Host in lower case without port and leading ``www.``; null for a null URL."""
    return F.regexp_replace(F.regexp_extract(F.lower(F.trim(url)), HOST, 1), r"^www\.", "")


def normal_line(line: Column) -> Column:
    """Lower case, each run of white space one blank, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(line), WHITE, " "))


def keyed_lines(pages: DataFrame) -> DataFrame:
    """One row for each line with a letter on a page with a URL.

    Columns page_id, line_no, site_key, line_key, url_key. The keys are 64-bit hashes; site and line together give 128
    bits, so that the shuffles below carry 16 bytes instead of the text. Null chunks give no rows.
    """
    lines = pages.where(F.col("url").isNotNull() & F.col("chunk").isNotNull()).select(
        F.col("page_id"),
        F.xxhash64(site_of(F.col("url"))).alias("site_key"),
        F.xxhash64("url").alias("url_key"),
        F.posexplode(F.split("chunk", "\n", -1)).alias("line_no", "line"),
    )
    return lines.where(F.col("line").rlike(r"\p{L}")).select(
        "page_id", "line_no", "site_key", F.xxhash64(normal_line(F.col("line"))).alias("line_key"), "url_key"
    )


def line_support(keyed: DataFrame) -> DataFrame:
    """(site_key, line_key, n_urls): on how many different URLs of its site each line stands.

    Spark removes repeated (site, line, URL) triples on the map side and shuffles them by all three keys before it
    counts, so a line that stands on every page of a hot site never meets in one task.
    """
    return keyed.groupBy("site_key", "line_key").agg(F.count_distinct("url_key").alias("n_urls"))

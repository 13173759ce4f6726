"""Problem 1: lines repeated across one site's documents.

Distributed PrefixSpan. The sequence of a page are the identifiers of its lines that are frequent on the site (level one
of the growth); infrequent lines between them are gaps. A pattern is projected as the places at which it starts, all
pages of all sites at once, and grows while it stands on enough different URLs of its site. The length doubles from round
to round, so that even pages of thousands of common lines need few rounds, none larger than the first; for the report of
the longest patterns smaller powers of two are added afterwards. A round is one count of (pattern, URL) pairs, combined on
the map side. What is frequent goes back to the places as a Bloom filter of
fixed size; a false hit costs work only, for the support of everything that is reported is counted. Every occurrence of a
frequent pattern, single lines included, is deleted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.lines import keyed_lines, line_support, site_of
from skein.session import written

MIN_SUPPORT = 8
#: Bits of one Bloom filter, 1 MB.
BITS = 1 << 23

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def line_sequences(pages: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """page_id, url_key, seq (line_no, item): the frequent lines of each page in order; pages without any give no row.

    ``item`` is a hash of site and line. Pages that share their id and URL are one sequence.
    """
    keyed = keyed_lines(pages)
    frequent = line_support(keyed).where(F.col("n_urls") >= min_support).select("site_key", "line_key")
    kept = keyed.join(frequent, ["site_key", "line_key"], "left_semi")
    place = F.struct("line_no", F.xxhash64("site_key", "line_key").alias("item"))
    return kept.groupBy("page_id", "url_key").agg(F.array_sort(F.collect_list(place)).alias("seq"))


class Places:
    """The places of one batch of sequences, one after another, with the longest frequent pattern known at each."""

    def __init__(self, batch: pa.RecordBatch):
        lists = batch.column("seq")
        flat = lists.flatten()
        self.line = flat.field(0).to_numpy(zero_copy_only=False)
        item = flat.field(1).to_numpy(zero_copy_only=False).astype(np.uint64)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        self.page = np.repeat(np.arange(len(sizes)), sizes)
        self.url = batch.column("url_key").to_numpy(zero_copy_only=False)
        n = len(item)
        self.at = np.arange(n)
        self.room = np.repeat(np.cumsum(sizes), sizes) - self.at
        self.length = np.ones(n, np.int64)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)])[: n + 1], dtype=np.uint64)
            self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BACK)])[: n + 1], dtype=np.uint64)
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(item * power[:n], dtype=np.uint64)])

    def patterns(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """A number for the pattern of each place and length, the same wherever it stands."""
        with np.errstate(over="ignore"):
            h = (self.sums[at + length] - self.sums[at]) * self.back[at] + length.astype(np.uint64)
            h = (h ^ (h >> np.uint64(31))) * _MIX
            return (h ^ (h >> np.uint64(29))).view(np.int64)

    def candidates(self, step: int, doubling: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places that may grow by ``step``, and the lengths they would have."""
        grown = self.length + step
        may = (self.length == step) if doubling else (self.length >= 2 * step)
        at = self.at[may & (grown <= self.room)]
        return at, grown[at]

    def witnesses(self, step: int, doubling: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places and lengths that count in a round: the candidates, and where lengths differ also the places that have
        grown beyond what others try. Known lengths are multiples of ``2 * step`` then, those tried odd ones of ``step``."""
        if doubling:
            return self.candidates(step, True)
        most = np.minimum(self.length + step, self.room) // step
        tried = np.where(self.length >= 2 * step, (most - 1) // 2, 0)
        at = np.repeat(self.at, tried)
        return at, (3 + 2 * (np.arange(len(at)) - np.repeat(np.cumsum(tried) - tried, tried))) * step

    def grow(self, rounds: list[tuple[int, bool, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Take the rounds so far; returns the places and lengths that each of them gave."""
        path = [(self.at, self.length.copy())]
        for step, doubling, bits in rounds:
            at, grown = self.candidates(step, doubling)
            found = self.patterns(at, grown)
            hit = np.ones(len(at), bool)
            for place in (found % BITS, (found >> 23) % BITS):
                hit &= (bits[place >> 6] >> (place & 63)) & 1 == 1
            self.length[at[hit]] = grown[hit]
            path.append((at[hit], grown[hit]))
        return path


def _filter_of(patterns: DataFrame) -> np.ndarray | None:
    """Bloom filter of the patterns, put together by bitwise aggregates; None if there are none."""
    n = F.lit(BITS)
    place = F.explode(F.array(F.pmod("pattern", n), F.pmod(F.shiftright("pattern", 23), n)))
    words = patterns.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("bits"))
    rows = words.collect()
    if not rows:
        return None
    out = np.zeros(BITS // 64, np.int64)
    out[[r["word"] for r in rows]] = [r["bits"] for r in rows]
    return out


def prefix_span(sequences: DataFrame, min_support: int = MIN_SUPPORT, supports: list[DataFrame] | None = None) -> list[tuple[int, bool, np.ndarray]]:
    """The rounds of the growth, each with its step and the filter of the patterns that were frequent.

    With ``supports`` the growth goes on from doubled lengths to the longest ones, and the tables (pattern, n) of each
    round's frequent patterns are appended to it.
    """
    spark = sequences.sparkSession
    rounds: list[tuple[int, bool, np.ndarray]] = []

    def frequent(step: int, doubling: bool) -> np.ndarray | None:
        shared = spark.sparkContext.broadcast(rounds)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                places = Places(batch)
                places.grow(shared.value)
                at, grown = places.witnesses(step, doubling)
                pairs = np.unique(np.stack([places.patterns(at, grown), places.url[places.page[at]]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["pattern", "url_key"])

        met = sequences.select("url_key", "seq").mapInArrow(run, "pattern bigint, url_key bigint")
        counted = met.groupBy("pattern").agg(F.count_distinct("url_key").alias("n")).where(F.col("n") >= min_support)
        if supports is not None:
            counted = written(counted)
            supports.append(counted)
        bits = _filter_of(counted)
        shared.destroy()
        return bits

    step = 1
    while (bits := frequent(step, True)) is not None:
        rounds.append((step, True, bits))
        step *= 2
    step = step // 2 if supports is not None else 0
    while step:
        bits = frequent(step, False)
        if bits is not None:
            rounds.append((step, False, bits))
        step //= 2
    return rounds


def repeated_occurrences(pages: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """page_id, line_no of each line in an occurrence of a sequence frequent on its site, single lines included.

    Frequent means at least ``min_support`` different URLs of the site. Input needs page_id, chunk and url; other columns
    are ignored. Pages with null URL or null chunk neither count nor give rows; blank lines and lines without a letter
    never count; the same URL fetched again counts once; a line repeated on one page counts once and is given at each
    place. An empty table gives an empty result.
    """
    sequences = written(line_sequences(pages, min_support))
    shared = pages.sparkSession.sparkContext.broadcast(prefix_span(sequences, min_support))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = Places(batch)
            places.grow(shared.value)
            covered = np.zeros(len(places.at) + 1, np.int64)
            np.add.at(covered, places.at, 1)
            np.add.at(covered, places.at + places.length, -1)
            gone = np.cumsum(covered[:-1]) > 0
            yield pa.RecordBatch.from_arrays([batch.column("page_id").take(pa.array(places.page[gone])), pa.array(places.line[gone], pa.int32())], names=["page_id", "line_no"])

    schema = T.StructType([*sequences.select("page_id").schema, T.StructField("line_no", T.IntegerType())])
    return sequences.mapInArrow(run, schema)


def frequent_patterns(pages: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """site, length, n_urls, lines: the longest frequent sequences, each as its lines on the page of least id.

    A sequence is given if somewhere it is the longest frequent one that starts at its place, and none that starts earlier
    reaches as far. ``n_urls`` are all different URLs on which it stands; ``lines`` are as they stand there, without the
    infrequent ones between them. An empty table gives an empty result.
    """
    sequences = written(line_sequences(pages, min_support))
    supports: list[DataFrame] = []
    shared = pages.sparkSession.sparkContext.broadcast(prefix_span(sequences, min_support, supports))
    single = sequences.select("url_key", F.explode("seq.item").alias("item")).groupBy("item").agg(F.count_distinct("url_key").alias("n"))
    schema = T.StructType([*sequences.select("page_id", "url_key").schema, *(T.StructField(c, T.LongType()) for c in ("start", "length", "pattern"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = Places(batch)
            sizes = batch.column("seq").value_lengths().to_numpy(zero_copy_only=False)
            first = np.cumsum(sizes) - sizes
            for at, length in places.grow(shared.value):
                page = pa.array(places.page[at])
                columns = [batch.column("page_id").take(page), batch.column("url_key").take(page), pa.array(at - first[places.page[at]]), pa.array(length), pa.array(places.patterns(at, length))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    tried = sequences.mapInArrow(run, schema)
    known = reduce(DataFrame.unionByName, supports)  # at least that of the first round, which may be empty
    # A pattern of one line is frequent to begin with; of the others the counts decide, not the filter.
    sure = tried.join(known, "pattern", "left").where((F.col("length") == 1) | F.col("n").isNotNull())
    longest = sure.groupBy("page_id", "url_key", "start").agg(F.max(F.struct("length", "pattern", "n")).alias("best")).select("page_id", "url_key", "start", "best.*")
    before = Window.partitionBy("page_id", "url_key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    outer = longest.withColumn("reach", F.max(end).over(before)).where(F.col("reach").isNull() | (end > F.col("reach")))
    seen = outer.groupBy("pattern", "length", "n").agg(F.min(F.struct("page_id", "url_key", "start")).alias("at")).select("length", "n", "at.*")
    shown = seen.join(sequences, ["page_id", "url_key"]).select("page_id", "url_key", "length", "n", F.expr("slice(seq, CAST(start + 1 AS INT), CAST(length AS INT))").alias("part"))
    shown = shown.withColumn("item", F.col("part")[0]["item"]).join(single.withColumnRenamed("n", "alone"), "item")
    text = pages.where(F.col("url").isNotNull()).select("page_id", F.xxhash64("url").alias("url_key"), site_of(F.col("url")).alias("site"), F.split("chunk", "\n", -1).alias("all")).dropDuplicates(["page_id", "url_key"])
    lines = F.transform("part", lambda p: F.get("all", p["line_no"]))
    return shown.join(text, ["page_id", "url_key"]).select("site", "length", F.coalesce("n", "alone").alias("n_urls"), lines.alias("lines"))


def remove_repeated(pages: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """page_id and ``chunk`` without the repeated lines, one row for each page; a null chunk stays null."""
    gone = repeated_occurrences(pages, min_support).groupBy("page_id").agg(F.collect_set("line_no").alias("gone"))
    kept = F.filter(
        F.transform(F.split("chunk", "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("x"))),
        lambda s: ~F.array_contains("gone", s["i"]),
    )
    clean = F.when(F.col("gone").isNull(), F.col("chunk")).otherwise(F.array_join(F.transform(kept, lambda s: s["x"]), "\n"))
    return pages.select("page_id", "chunk").join(gone, "page_id", "left").select("page_id", clean.alias("chunk"))


def frequent_sequences(pages: DataFrame, min_support: int = MIN_SUPPORT, max_length: int | None = None) -> DataFrame:
    """site_key, length, pattern (hash of the sequence), n_urls: all frequent sequences of neighbouring lines.

    The plain growth, without gaps and one line a level: a level holds, for each frequent pattern, the places where it
    ends; the next level appends the line that follows there (blank and infrequent lines cut a sequence) and keeps the
    extensions with enough different URLs. Each place is projected once a level, so a level is never larger than the first.
    Growth ends at the first empty level, or at ``max_length`` if one is given.
    """
    keyed = keyed_lines(pages)
    frequent = line_support(keyed).where(F.col("n_urls") >= min_support)
    step = Window.partitionBy("page_id").orderBy("line_no")
    base = (
        keyed.join(frequent.select("site_key", "line_key"), ["site_key", "line_key"], "left_semi")
        .withColumn("next_key", F.when(F.lead("line_no").over(step) == F.col("line_no") + 1, F.lead("line_key").over(step)))
        .withColumn("place", F.row_number().over(step))
    )
    base = written(base)
    places = base.select("page_id", "place", "next_key", "url_key", "site_key", F.col("line_key").alias("pattern"))
    levels = [frequent.select("site_key", F.col("line_key").alias("pattern"), "n_urls", F.lit(1).alias("length"))]
    following = base.select("page_id", (F.col("place") - 1).alias("place"), F.col("next_key").alias("after"))
    length = 1
    while max_length is None or length < max_length:
        length += 1
        grown = (
            places.where(F.col("next_key").isNotNull())
            .withColumn("pattern", F.xxhash64("pattern", "next_key"))
            .join(following, ["page_id", "place"])
            .select("page_id", (F.col("place") + 1).alias("place"), F.col("after").alias("next_key"), "url_key", "site_key", "pattern")
        )
        kept = grown.groupBy("site_key", "pattern").agg(F.count_distinct("url_key").alias("n_urls")).where(F.col("n_urls") >= min_support)
        kept = written(kept)
        if kept.isEmpty():
            break
        levels.append(kept.select("site_key", "pattern", "n_urls", F.lit(length).alias("length")))
        places = written(grown.join(kept.select("site_key", "pattern"), ["site_key", "pattern"], "left_semi"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.select("site_key", "length", "pattern", "n_urls")

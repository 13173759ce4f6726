"""Entity resolution: similar names, canonical forms, average linkage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import alike
from skein.functions.linkage import linked_clusters
from skein.functions.text import normal_name
from skein.operators.chunking import numbered
from skein.operators.components import connected_components
from skein.operators.retrieval import first_wins
from skein.session import written

PERCENT = 85
#: The ratio counts an insertion half, so names may differ by more edits, in per cent of the longer, than it says.
EDITS = 10
#: Names of a component whose average linkage takes a table of all pairs; that of more keeps the pairs that are alike.
TABLE_NAMES = 1000
#: Names of a block, of which two are compared in a task, and blocks of fewer names; tasks at once; rows of a batch of pairs.
BLOCK_NAMES, FEW_NAMES, BLOCKS, CELLS, BATCH = 16_384, 2_048, 8, 2_000, 10_000
LINKAGE_TASKS = 96
# Types that say nothing about a mention; so does a missing type.
GENERIC_TYPES = ("MISC", "REBEL_ENTITY")


def _signature(name: str) -> Column:
    """64 bits: which characters, by their codes modulo 64, a name has an odd number of. An edit turns two bits at most."""
    return F.expr(f"aggregate(split({name}, ''), 0L, (bits, c) -> bits ^ shiftleft(1L, ascii(c) % 64))")


def similar_names(names: DataFrame, key: str = "name", percent: int = PERCENT) -> DataFrame:
    """a, b, distance: pairs of distinct names, a < b, with 1 - distance / longer length of at least ``percent`` %.

    Exact by pigeonhole (PassJoin): the longer name is cut into one segment more than the edits allowed, so one segment
    stands unchanged in the other name, at most so many places off. Only names that share such a segment meet.
    """
    off = (100 - percent) / 100.0
    distinct = written(names.select(F.col(key).alias("n")).where(F.length("n") > 0).distinct().withColumn("l", F.length("n")).withColumn("bits", _signature("n")))
    allowed = lambda length: F.floor(length * off + 1e-9).cast("int")
    size = lambda length, i: F.floor(length / (allowed(length) + 1)).cast("int") + F.when(i >= allowed(length) + 1 - length % (allowed(length) + 1), 1).otherwise(0)
    base = lambda length: F.floor(length / (allowed(length) + 1)).cast("int")
    start = lambda length, i: i * base(length) + F.greatest(F.lit(0), i - (allowed(length) + 1 - length % (allowed(length) + 1))) + 1
    long = distinct.withColumn("i", F.explode(F.sequence(F.lit(0), allowed(F.col("l"))))).select(
        F.col("n").alias("long"), F.col("l").alias("length"), "i", F.col("n").alias("_n"), "l", F.col("bits").alias("long_bits")
    )
    long = long.select("long", "long_bits", "length", "i", F.substr("_n", start(F.col("l"), F.col("i")), size(F.col("l"), F.col("i"))).alias("segment"))
    most = F.floor(F.col("l") / (1 - off) + 1e-9).cast("int")
    short = distinct.select(F.col("n").alias("short"), "l", "bits", F.explode(F.sequence(F.col("l"), F.greatest(F.col("l"), most))).alias("length"))
    short = short.withColumn("i", F.explode(F.sequence(F.lit(0), allowed(F.col("length")))))
    p, k = start(F.col("length"), F.col("i")), allowed(F.col("length"))
    short = short.withColumn("at", F.explode(F.sequence(F.greatest(F.lit(1), p - k), F.greatest(F.lit(1), F.least(F.col("l"), p + k)))))
    short = short.select("short", "l", "bits", "length", "i", F.substr("short", F.col("at"), size(F.col("length"), F.col("i"))).alias("segment"))
    one = (F.col("short") != F.col("long")) & ((F.col("l") < F.col("length")) | (F.col("short") < F.col("long")))
    most_edits = F.floor((100 - percent) * F.col("length") / 100).cast("int")
    near = F.bit_count(F.col("bits").bitwiseXOR(F.col("long_bits"))) <= 2 * most_edits
    # Both sides grow by what is exploded, which Spark's estimate does not see: neither may be broadcast. Few of the
    # pairs that share a segment are similar, so they are verified where they meet and only those that are are shuffled.
    met = short.hint("merge").join(long.hint("merge"), ["length", "i", "segment"]).where(one & near)
    far = F.call_function("levenshtein", F.col("short"), F.col("long"), most_edits)  # -1 beyond
    pairs = met.select(F.least("short", "long").alias("a"), F.greatest("short", "long").alias("b"), far.alias("distance"))
    return pairs.where("distance >= 0").distinct()


def _cells(names: DataFrame, percent: float) -> DataFrame:
    """a, b of the names (n) that :func:`alike.tiled` finds, in cells of two blocks of names in the order of length."""
    placed = written(numbered(names.withColumn("l", F.length("n")), ["l", "n"], "_k"))
    size = min(BLOCK_NAMES, max(FEW_NAMES, -(-placed.count() // BLOCKS)))
    placed = written(placed.select("n", "l", F.floor(F.col("_k") / size).alias("block")))
    ends = [(r["block"], r["low"], r["high"]) for r in placed.groupBy("block").agg(F.min("l").alias("low"), F.max("l").alias("high")).collect()]
    # Names that are so much longer have a ratio of 60 at most.
    cells = [(p, q) for p, _, high in ends for q, low, _ in ends if p <= q and (low <= alike.LONGEST * high or 100 * alike.SHORT_PART >= percent)]
    if not cells:
        return placed.select(F.col("n").alias("a"), F.col("n").alias("b")).limit(0)
    other: dict[int, list[int]] = {}
    for p, q in cells:
        other.setdefault(p, []).append(q)
        if p != q:
            other.setdefault(q, []).append(p)
    partners = names.sparkSession.createDataFrame(pa.table({"block": list(other), "other": list(other.values())}))
    rows = placed.join(F.broadcast(partners), "block").select("n", "block", F.explode("other").alias("other"))
    rows = rows.select("n", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches))
        sides = []
        for block in sorted(set(group["block"].to_pylist())):
            own = group.filter(pc.equal(group["block"], block))
            sides.append(alike.Names(sorted(own["n"].to_pylist(), key=lambda x: (len(x), x))))
        left, right = (pa.array(side.names, pa.string()) for side in (sides[0], sides[-1]))
        # A common token can give more pairs than are held at once.
        for i, j in alike.tiled(sides[0], sides[1] if len(sides) > 1 else None, percent):
            for x in range(0, len(i), BATCH):
                found = left.take(pa.array(i[x : x + BATCH])), right.take(pa.array(j[x : x + BATCH]))
                turned = pc.less(*found)
                yield pa.RecordBatch.from_arrays([pc.if_else(turned, *found), pc.if_else(turned, *found[::-1])], ["a", "b"])

    return rows.repartition(min(len(cells), CELLS), "p", "q").groupBy("p", "q").applyInArrow(inside, "a string, b string")


def weighted_names(names: DataFrame, key: str = "name", percent: int = PERCENT) -> DataFrame:
    """a, b, score: all pairs of distinct names, a < b, whose weighted ratio is at least ``percent``.

    All pairs of names are compared, by tokens in common and the counts of their characters, in cells of blocks of names;
    what can have the ratio is scored. With lengths of a ratio of 1.5 to 8 a token in common is enough for 85.5, so that
    a token of many names gives about the square of them as pairs.
    """
    distinct = names.select(F.col(key).alias("n")).where(F.length("n") > 0).distinct()
    return _cells(distinct, percent).mapInArrow(alike.scored(percent), "a string, b string, score double")


def canonical_forms(mentions: DataFrame, cluster: str, prefer_specific: bool = False) -> DataFrame:
    """cluster, canonical: the representative of each cluster of (mention, type, freq).

    By default generic types come first, then the highest frequency, the shortest and the first mention; with
    ``prefer_specific`` generic types come last.
    """
    generic = F.coalesce(F.col("type").isin(*GENERIC_TYPES), F.lit(True)).cast("int")
    order = [generic if prefer_specific else -generic, -F.col("freq"), F.length("mention"), F.col("mention")]
    return first_wins(mentions.select(cluster, "mention", "type", "freq"), [cluster], order).select(cluster, F.col("mention").alias("canonical"))


def mention_counts(triplets: DataFrame) -> DataFrame:
    """mention, type, freq over heads and tails of (head, head_type, tail, tail_type)."""
    ends = F.array(*(F.struct(F.col(s).alias("mention"), F.col(f"{s}_type").alias("type")) for s in ("head", "tail")))
    return triplets.select(F.inline(ends)).where(F.length("mention") > 0).groupBy("mention", "type").agg(F.count(F.lit(1)).alias("freq"))


def average_linkage(names: list[str], cut: float = 100 - PERCENT) -> list[int]:
    """Labels of average-linkage clusters of names under 100 - weighted ratio, merged while the least mean is below ``cut``."""
    n = len(names)
    d = 100.0 - alike.score_matrix(names)
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(n), np.arange(n)
    # The nearest of each name, the first of equal ones, and how near it is.
    at = d.argmin(1) if n else label
    least = d[np.arange(n), at]
    while n > 1:
        i = int(least.argmin())
        if least[i] >= cut:
            break
        i, j = sorted((i, int(at[i])))
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        merged[[i, j]] = np.inf
        d[i], d[:, i] = merged, merged
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
        stale = np.flatnonzero((at == i) | (at == j))
        stale = np.union1d(stale, [i, j])
        nearer = (merged < least) | ((merged == least) & (i < at))
        at[nearer], least[nearer] = i, merged[nearer]
        at[stale] = d[stale].argmin(1)
        least[stale] = d[stale, at[stale]]
    return label.tolist()


def linked_parts(links: DataFrame, percent: int = PERCENT, most: int | None = None) -> DataFrame:
    """node, component of the names that links (a, b, score) join; if ``most`` is given, none with more names.

    Clusters are those of whole components; only who asks for ``most`` gets parts. Larger components are then joined anew by links of a higher score, of 90, 95 and at last 100, until they are small
    enough; what identical scores still hold together then is cut in the order of its names. Average linkage joins the
    most alike first, so a cut separates what it would join last. Names without a link that is left are not listed.
    """
    nodes = links.select(F.col("a").alias("name")).union(links.select("b")).distinct()
    known = written(numbered(nodes, ["name"], "node").select("name", F.col("node").cast("bigint").alias("node")))
    a, b = known.withColumnsRenamed({"name": "a", "node": "x"}), known.withColumnsRenamed({"name": "b", "node": "y"})
    parts = _small_parts(written(links.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b"), "score")), percent, most)
    first = known.withColumnsRenamed({"name": "first", "node": "component"})
    return parts.join(known, "node").join(first, "component").select(F.col("name").alias("node"), F.col("first").alias("component"))


def _small_parts(links: DataFrame, percent: int, most: int | None) -> DataFrame:
    """:func:`linked_parts` of numbers."""
    if most is None:
        return connected_components(links, "a", "b")
    found, level, least = None, links, float(percent)
    while True:
        parts = written(connected_components(level, "a", "b"))
        sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > most).select("component")
        sizes = written(sizes)
        small = parts.join(sizes, "component", "left_anti").select("node", "component")
        found = small if found is None else found.unionByName(small)
        if sizes.isEmpty():
            return found
        big = parts.join(sizes, "component", "left_semi")
        if least > 99.9:
            place = F.row_number().over(Window.partitionBy("component").orderBy("node")) - 1
            cut = big.withColumn("_k", F.floor(place / most))
            return found.unionByName(cut.select("node", F.min("node").over(Window.partitionBy("component", "_k")).alias("component")))
        least = next((x for x in (90.0, 95.0) if x > least), 99.95)
        inside = big.select("node")
        level = written(level.where(F.col("score") >= least).join(inside.withColumnRenamed("node", "a"), "a", "left_semi").join(inside.withColumnRenamed("node", "b"), "b", "left_semi"))


def name_clusters(names: DataFrame, key: str = "name", percent: int = PERCENT) -> DataFrame:
    """name, cluster: average linkage of all names with a similar one; others are not listed.

    A component is clustered whole, in a task, whatever its size; its links go there too if it has more than
    ``TABLE_NAMES`` names, for a table of all its pairs would be too large.
    """
    cut, table = 100 - percent, TABLE_NAMES
    links = written(weighted_names(names, key, percent))
    parts = written(linked_parts(links, percent))
    large = parts.groupBy("component").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > table).select("component")
    inside = parts.join(large, "component", "left_semi").withColumnRenamed("node", "a")
    nothing = F.lit(None)
    rows = parts.select("component", F.col("node").alias("a"), nothing.cast("string").alias("b"), nothing.cast("double").alias("score"))
    rows = rows.unionByName(links.join(inside, "a").select("component", "a", "b", "score"))

    def clustered(group: pa.Table) -> pa.Table:
        alone = pc.is_null(group["b"])
        own = pa.array(sorted(group.filter(alone)["a"].to_pylist()), pa.string())
        if len(own) <= table:
            labels = average_linkage(own.to_pylist(), cut)
        else:
            held = group.filter(pc.invert(alone))
            x, y = (pc.index_in(held[side], own).to_numpy() for side in ("a", "b"))
            labels = linked_clusters(own.to_pylist(), x, y, held["score"].to_numpy(), cut)
        return pa.table({"name": own, "cluster": own.take(pa.array(labels))})

    # Few rows take long here: their bytes say nothing about how many tasks they need.
    return rows.repartition(LINKAGE_TASKS, "component").groupBy("component").applyInArrow(clustered, "name string, cluster string")


def resolve(triplets: DataFrame, percent: int = PERCENT, prefer_specific: bool = False) -> DataFrame:
    """Triplets with heads and tails in canonical form; new self loops are dropped.

    Names whose weighted ratio is high are joined to components, and inside each average linkage decides.
    Each name is clustered once, however many types and mentions it has.
    """
    counts = mention_counts(triplets).withColumn("name", normal_name(F.col("mention")))
    clusters = name_clusters(counts, "name", percent)
    placed = counts.join(clusters, "name", "left").withColumn("cluster", F.coalesce("cluster", "name"))
    forms = placed.select("mention", "type", "cluster").join(canonical_forms(placed, "cluster", prefer_specific), "cluster").select("mention", "type", "canonical")
    return apply_canonical(triplets, forms)


def apply_canonical(triplets: DataFrame, forms: DataFrame) -> DataFrame:
    """Replace heads and tails by (mention, type) -> canonical, and drop triplets whose ends became the same."""
    out = triplets
    for side in ("head", "tail"):
        named = forms.select(F.col("mention").alias(side), F.col("type").alias("_t"), F.col("canonical").alias("_c"))
        out = out.join(named, (out[side] == named[side]) & out[f"{side}_type"].eqNullSafe(named["_t"]), "left").drop(named[side]).drop("_t")
        out = out.withColumn(side, F.coalesce("_c", side)).drop("_c")
    return out.where(F.col("head").isNull() | F.col("tail").isNull() | (F.col("head") != F.col("tail"))).select(*triplets.columns)

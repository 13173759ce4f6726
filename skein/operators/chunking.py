"""Operators that cut texts into rows, and those that group rows into batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.session import checkpoint

SIZE, OVERLAP = 400, 7


def token_windows(texts: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """key, pos, chunk, n_tokens, chunk_id: overlapping windows of words.

    A window starts every ``size - overlap`` words until one reaches the end, so no last window is overlap alone. Null
    and blank texts give no row. No shuffle: each text is cut where it is read.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the window")
    step = size - overlap
    tokens = F.col("_tokens")
    last = F.greatest(F.lit(0), F.ceil((F.size(tokens) - size) / F.lit(step)).cast("int"))
    cut = texts.select(key, T.words(F.col(text)).alias("_tokens")).where(F.size("_tokens") > 0)
    rows = cut.select(key, "_tokens", F.explode(F.sequence(F.lit(0), last)).alias("pos"))
    window = F.slice(tokens, F.col("pos") * step + 1, F.lit(size))
    return rows.select(key, "pos", F.array_join(window, " ").alias("chunk"), F.size(window).alias("n_tokens")).withColumn("chunk_id", T.stable_id(F.col("chunk")))


def sentence_rows(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, sentence: the non-blank sentences of each text, numbered from 0 with blank ones counted."""
    rows = texts.select(key, F.posexplode(T.sentences(F.col(text))).alias("pos", "sentence"))
    return rows.where(~T.is_blank(F.col("sentence")))


def batches(rows: DataFrame, order: list[str], set_size: int, partition: list[str] | None = None) -> DataFrame:
    """``rows`` with batch: groups of ``set_size`` in the given order, numbered from 0, inside each partition.

    A total numbering without a partition sorts by range first and numbers inside each range, so no task sees all rows.
    """
    if partition:
        number = F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1
        return rows.withColumn("batch", F.floor(number / set_size))
    return numbered(rows, order, "_n").withColumn("batch", F.floor(F.col("_n") / set_size)).drop("_n")


def numbered(rows: DataFrame, order: list[str | Column], name: str = "human_readable_id") -> DataFrame:
    """``rows`` with a gapless number from 0 in the given total order.

    Rows are sorted by range; each range numbers its own rows, and the sizes of the ranges before it are added. Only
    one count for each range is brought together.
    """
    # Written once: sampled range bounds and merged partitions could differ if it were computed twice.
    ranged = checkpoint(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    local = Window.partitionBy("_part").orderBy(*order)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", "_before")
    return (
        ranged.withColumn("_local", F.row_number().over(local) - 1)
        .join(F.broadcast(before), "_part")
        .withColumn(name, F.col("_local") + F.coalesce("_before", F.lit(0)))
        .drop("_part", "_local", "_before")
    )


def sample_under_budget(rows: DataFrame, key: str, text: str, max_tokens: int, seed: int = 42) -> DataFrame:
    """key, n_tokens, running: rows in a seeded random order until the first would pass the token budget.

    The order is a hash of key and seed. A range of hashes that surely holds the budget is kept first, so the running
    sum orders little more than the sample itself.
    """
    sized = rows.select(key, T.word_count(F.col(text)).alias("n_tokens")).withColumn("_order", F.xxhash64(F.lit(seed), key))
    spread = sized.groupBy(F.shiftright("_order", 52).alias("_slot")).agg(F.sum("n_tokens").alias("_sum"), F.max("n_tokens").alias("_most"))
    order = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = spread.withColumn("_before", F.coalesce(F.sum("_sum").over(order), F.lit(0))).where(F.col("_before") <= max_tokens).select("_slot", "_before")
    near = sized.withColumn("_slot", F.shiftright("_order", 52)).join(F.broadcast(slots), "_slot")
    within = Window.partitionBy("_slot").orderBy("_order", key).rowsBetween(Window.unboundedPreceding, 0)
    summed = near.withColumn("running", F.col("_before") + F.sum("n_tokens").over(within))
    first = summed.where(F.col("running") > max_tokens).agg(F.min(F.struct("running", "_order", key)).alias("s"))
    return summed.crossJoin(F.broadcast(first)).where((F.col("running") <= max_tokens) & (F.col("s").isNull() | (F.struct(F.col("running"), F.col("_order"), F.col(key)) < F.col("s")))).select(key, "n_tokens", "running")


def running_totals(rows: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows before each in a total order; no task sees more than a range of them."""
    ranged = checkpoint(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).withColumn("_value", value))
    sizes = ranged.groupBy("_part").agg(F.sum("_value").alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", "_before")
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_own", F.coalesce(F.sum("_value").over(own), F.lit(0))).join(F.broadcast(before), "_part")
    return summed.withColumn(name, F.col("_own") + F.coalesce("_before", F.lit(0))).drop("_part", "_value", "_own", "_before")


def corpus_parts(texts: DataFrame, group: str, order: str, text: str, separator: int = 2) -> DataFrame:
    """group, order, start, chars, text: the texts of each group in order, with where each starts in their concatenation.

    ``separator`` characters stand between two. The joined text of a group is as long as the group is large, so it stays in
    parts; null texts are left out.
    """
    kept = texts.where(F.col(text).isNotNull() & F.col(group).isNotNull()).select(group, order, text, F.length(text).alias("chars"))
    placed = running_totals(kept, [group, order], F.col("chars") + separator, "_at")
    first = placed.groupBy(group).agg(F.min("_at").alias("_first"))
    return placed.join(first, group).select(group, order, (F.col("_at") - F.col("_first")).alias("start"), "chars", text)

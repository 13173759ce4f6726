"""Verified MinHash classes of distinct short texts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.components import connected_components
from skein.session import written

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 2  # a pair at the least similarity shares no band with a chance below one in ten million
#: Members of one band bucket that a task compares with each other or with another such block.
BLOCK = 2000


def shingles(text: str, size: int = SHINGLE) -> frozenset[tuple[str, ...]]:
    """Runs of ``size`` words; a shorter text is one shingle of all its words."""
    words = text.split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def _hashes(found: frozenset[tuple[str, ...]]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(" ".join(s)) >> 32 for s in found], np.uint64)


_draw = np.random.default_rng(7)
_SLOPE, _SHIFT = _draw.integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint64), _draw.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint64)
_MIX, _BAND = np.array([0x9E3779B1, 0x85EBCA77], np.uint64), np.arange(BANDS, dtype=np.uint64)


def signature_bands(text: str) -> list[int]:
    """One 64-bit key for each band of the MinHash signature."""
    found = shingles(text)
    if not found:
        return []
    least = ((_hashes(found)[:, None] * _SLOPE + _SHIFT) % np.uint64((1 << 31) - 1)).min(axis=0).reshape(BANDS, ROWS)
    mixed = (least * _MIX).sum(axis=1) * np.uint64(BANDS) + _BAND
    return mixed.astype(np.int64).tolist()


def prefix(text: str, similarity: float) -> list[int]:
    """Hashes of the first shingles in their order, so many that two texts of the similarity share one."""
    found = np.sort(_hashes(shingles(text)))
    return found[: len(found) - math.ceil(similarity * len(found) - 1e-9) + 1].astype(np.int64).tolist()


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["src", "dst"])


def text_classes(texts: DataFrame, key: str, text: str, similarity: float = SIMILARITY) -> DataFrame:
    """key, class_key: the least key of each text's class; texts must be distinct.

    Two texts are linked if they share a band and the Jaccard similarity of their shingles is verified. Inside a bucket
    an inverted index finds the pairs, and only a spanning forest of the links leaves the task. A bucket of more than
    ``BLOCK`` texts falls into smaller ones by the first shingles of each text in the order of their hashes: two texts
    that are similar enough share one of those, so no link is lost. What is still larger then is cut into blocks, and each
    pair of blocks is a task of its own. Texts without a link are their own class.
    """
    schema = f"{key} bigint, {text} string, band bigint"

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own, keys = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = signature_bands(t or "")
                ids += [i] * len(found)
                own += [t] * len(found)
                keys += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own, pa.string()), pa.array(keys, pa.int64())], names=[key, text, "band"])

    def fall_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = [prefix(t, similarity) for t in batch.column(2).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(starts)), [len(s) for s in starts]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([x for s in starts for x in s], pa.int64()), batch.column(1).take(at), batch.column(2).take(at)], names=["band", "part", key, text])

    banded = written(texts.select(key, text).mapInArrow(bands, schema))
    sizes = banded.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met = banded.join(sizes, "band")
    small = met.where(F.col("members") <= BLOCK).select("band", F.lit(0).cast("bigint").alias("part"), key, text)
    split = met.where(F.col("members") > BLOCK).select("band", key, text).mapInArrow(fall_apart, f"band bigint, part bigint, {key} bigint, {text} string")
    parts = small.unionByName(split)
    counts = parts.groupBy("band", "part").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    placed = (
        parts.join(counts, ["band", "part"])
        .withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64(key), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("band", "part", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", key, text)
    )

    def forest(ids: list[int], own: list[int], found: list[frozenset], apart: bool) -> list[tuple[int, int]]:
        index: dict = {}
        root = list(range(len(ids)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        links = []
        for i, mine in enumerate(found):
            shared: dict[int, int] = {}
            for s in mine:
                for j in index.setdefault(s, []):
                    shared[j] = shared.get(j, 0) + 1
                index[s].append(i)
            for j, n in shared.items():
                if (not apart or own[i] != own[j]) and top(i) != top(j) and n >= similarity * (len(mine) + len(found[j]) - n):
                    root[top(i)] = top(j)
                    links.append((ids[i], ids[j]))
        return links

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; one pair of blocks is held at a time."""
        now, ids, own, found, links = None, [], [], [], []
        for batch in batches:
            for band, part, low, high, mine, i, t in zip(*(c.to_pylist() for c in batch.columns)):
                if (band, part, low, high) != now:
                    links += forest(ids, own, found, now is not None and now[2] != now[3])
                    now, ids, own, found = (band, part, low, high), [], [], []
                ids.append(i)
                own.append(mine)
                found.append(shingles(t))
            yield _pairs(links)
            links = []
        yield _pairs(forest(ids, own, found, now is not None and now[2] != now[3]))

    at = ["band", "part", "low", "high"]
    links = placed.repartition(*at).sortWithinPartitions(*at).mapInArrow(buckets, "src bigint, dst bigint")
    classes = connected_components(links).withColumnsRenamed({"node": key, "component": "class_key"})
    return texts.select(key).join(classes, key, "left").select(key, F.coalesce("class_key", key).alias("class_key"))

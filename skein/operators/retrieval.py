"""Exact search of a stated set of queries against all rows, rank fusion, and ranked selections."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

#: Queries that travel in one broadcast; more queries are searched in further passes over the rows.
BLOCK = 1024
#: Texts that are scored against a block of queries at once.
ROWS = 1000
# The term-frequency weights of the sparse vectors.
K1, B, AVERAGE_LENGTH = 1.2, 0.75, 256.0
RRF_K = 60


def _blocks(queries: DataFrame, size: int) -> Iterator[list]:
    block: list = []
    for row in queries.toLocalIterator():
        block.append(tuple(row))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def _best(rows: DataFrame, queries: DataFrame, k: int, key: str, scorer: Callable, block: int, threshold: float | None = None) -> DataFrame:
    """query_id, key, score, rank. Every partition keeps its own ``k`` best rows of each query of a block; only those are
    shuffled. ``scorer(block)`` makes a function from an Arrow batch to pairs of row numbers and a matrix of scores, one
    line for each query; scores that are not above ``threshold`` do not count."""
    spark = rows.sparkSession
    schema = ST.StructType([ST.StructField("query_id", ST.LongType()), ST.StructField(key, ST.LongType()), ST.StructField("score", ST.DoubleType())])
    found = spark.createDataFrame([], schema)
    for part in _blocks(queries, block):
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            score = scorer(asked)
            heaps: list[list[tuple[float, int]]] = [[] for _ in asked]
            # What a row must reach to be among the best of its query so far; ties are decided by the id.
            floor = np.full(len(asked), -np.inf if threshold is None else np.nextafter(threshold, np.inf))
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for rows_at, scores in score(batch):
                    least = floor
                    if scores.shape[1] > k:
                        cut = scores.shape[1] - k
                        least = np.maximum(floor, np.partition(scores, cut, axis=1)[:, cut])
                    for q, r in zip(*np.nonzero(scores >= least[:, None])):
                        item, heap = (float(scores[q, r]), -int(ids[rows_at[r]])), heaps[q]
                        if len(heap) < k:
                            heapq.heappush(heap, item)
                        elif item > heap[0]:
                            heapq.heapreplace(heap, item)
                        if len(heap) == k:
                            floor[q] = max(floor[q], heap[0][0])
            out = [(asked[q][0], -i, s) for q, heap in enumerate(heaps) for s, i in heap]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())],
                names=["query_id", key, "score"],
            )

        found = found.unionByName(rows.mapInArrow(run, schema))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(points: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", threshold: float | None = None, block: int = BLOCK) -> DataFrame:
    """query_id, key, score, rank: the ``k`` points with the highest cosine for each query, ties by id.

    ``queries`` has the id first and the vector second. Null vectors are skipped, a zero vector has cosine 0 with all.
    With ``threshold`` only points above it count. All vectors have the same length.
    """

    def unit(matrix: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(matrix, axis=1, keepdims=True)
        return np.where(size > 1e-9, matrix / np.where(size > 0, size, 1), 0.0)

    def scorer(asked: list) -> Callable:
        matrix = unit(np.array([q[1] for q in asked], np.float64))

        def score(batch: pa.RecordBatch):
            column = batch.column(1)
            there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            for start in range(0, len(there), ROWS):
                at = there[start : start + ROWS]
                flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield at, matrix @ unit(flat.reshape(len(at), -1)).T

        return score

    return _best(points.select(key, vector), queries, k, key, scorer, block, threshold)


def term_weights(terms: list[str]) -> dict[str, float]:
    """Weight of each term by its frequency and the length of the text; no inverse document frequency."""
    size = len(terms)
    return {t: n * (K1 + 1) / (n + K1 * (1 - B + B * size / AVERAGE_LENGTH)) for t, n in Counter(terms).items()}


#: Terms that so many queries of a block ask for are scored by a matrix product, rarer ones by their postings.
COMMON = 32


def sparse_search(texts: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """query_id, key, score, rank: the ``k`` texts with the highest dot product of term weights; no match, no row.

    Scores are rounded to nine places before they are ranked, so that the order of a sum decides no tie.
    """

    def scorer(asked: list) -> Callable:
        split = re.compile("[a-z0-9]+").findall
        met: dict[str, list[tuple[int, float]]] = {}
        for q, (_, question) in enumerate(asked):
            for t, w in term_weights(split((question or "").lower())).items():
                met.setdefault(t, []).append((q, w))
        common = {t: n for n, t in enumerate(t for t, rows in met.items() if len(rows) >= COMMON)}
        matrix = np.zeros((len(common), len(asked)))
        for t, n in common.items():
            at, w = zip(*met[t])
            matrix[n, list(at)] = w
        rare = {t: (np.array([q for q, _ in rows]), np.array([w for _, w in rows])) for t, rows in met.items() if t not in common}

        def score(batch: pa.RecordBatch):
            column = batch.column(1)
            for start in range(0, len(column), ROWS):
                part = column.slice(start, ROWS).to_pylist()
                often, scores = np.zeros((len(part), len(common))), np.zeros((len(part), len(asked)))
                for row, text_ in enumerate(part):
                    for t, w in term_weights(split((text_ or "").lower())).items():
                        n = common.get(t)
                        if n is not None:
                            often[row, n] = w
                        elif t in rare:
                            at, weights = rare[t]
                            scores[row, at] += weights * w
                yield np.arange(start, start + len(part)), np.ascontiguousarray(np.round(scores + often @ matrix, 9).T)

        return score

    return _best(texts.select(key, text), queries, k, key, scorer, block, 0.0)


def fuse(lists: list[DataFrame], k: int, key: str, rrf_k: int = RRF_K) -> DataFrame:
    """query_id, key, score, rank: reciprocal rank fusion of ranked lists; a row's score sums 1 / (rrf_k + rank)."""
    joined = lists[0].select("query_id", key, "rank")
    for one in lists[1:]:
        joined = joined.unionByName(one.select("query_id", key, "rank"))
    scored = joined.groupBy("query_id", key).agg(F.sum(1.0 / (F.lit(rrf_k) + F.col("rank"))).alias("score"))
    return top_per_group(scored, ["query_id"], [F.desc("score"), F.col(key)], k)


def hybrid_search(points: DataFrame, texts: DataFrame, vectors: DataFrame, questions: DataFrame, n: int, factor: int = 5, key: str = "doc_id") -> DataFrame:
    """Dense and sparse lists of ``n * factor`` rows each, fused to ``n``."""
    return fuse([nearest(points, vectors, n * factor, key), sparse_search(texts, questions, n * factor, key)], n, key)


def top_per_group(rows: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group with rank; Spark limits each group before it shuffles."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def first_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key: the first in the given total order, aggregated on the map side."""
    names = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in names))


def boosted(chunks: DataFrame, seed_boost: float = 0.02, traversal_boost: float = 0.01, k: int = 30) -> DataFrame:
    """Chunks (entity_id, chunk_id, text, relevance, is_seed) by relevance plus boost: the ``k`` best, then one row for each text.

    The cut comes before the removal of repeated texts, so fewer than ``k`` can remain.
    """
    score = F.coalesce("relevance", F.lit(0.0)) + F.when(F.col("is_seed"), seed_boost).otherwise(traversal_boost)
    best = chunks.where(F.col("text") != "").withColumn("score", score).orderBy(F.desc("score"), "entity_id", "chunk_id").limit(k)
    return first_wins(best, ["text"], [-F.col("score"), F.col("entity_id"), F.col("chunk_id")])

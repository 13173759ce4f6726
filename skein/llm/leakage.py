"""Problem 7: evaluation texts inside training text, found with suffix arrays of the corpus.

The corpus is cut into shards of whole documents with a bounded number of words. The suffix array of a shard orders all
its word suffixes completely, by prefix doubling. It knows nothing of the passages, so it is built once and serves every
block of them: each suffix of each passage is searched by bisection, and every place found is extended to its longest
match.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import checkpoint_path, written

MIN_WORDS = 12
#: Words of passages in one broadcast; the shards are searched once for each block of so many.
BLOCK_WORDS = 2_000_000
#: A shard is closed when it holds so many words.
SHARD_WORDS = 500_000
#: Pairs of a passage's suffix and a place that are extended at once.
PAIRS = 1_000_000
#: Words whose number a worker remembers.
KNOWN = 500_000

SHARD = "ids array<bigint>, ends binary, words binary, codes binary, suffixes binary"

words_of = re.compile(r"[^\W_]+").findall


class Numbers:
    """64-bit numbers of words, above zero, remembered within a bound."""

    def __init__(self) -> None:
        import xxhash

        self._hash, self._known = xxhash.xxh3_64_intdigest, {}

    def __call__(self, text: str | None) -> list[int]:
        known, out = self._known, []
        if len(known) > KNOWN:
            known.clear()
        for w in words_of((text or "").lower()):
            n = known.get(w)
            if n is None:
                n = known[w] = (self._hash(w) >> 1) + 1
            out.append(n)
        return out


@dataclass
class Passages:
    """The passages as word numbers, one after another, each closed by a zero; ``starts`` are those of their suffixes that
    have enough words."""

    stream: np.ndarray
    owner: np.ndarray
    starts: np.ndarray
    min_words: int

    def __init__(self, rows: list[tuple[int, str]], min_words: int):
        numbers, stream, owner, starts = Numbers(), [], [], []
        for item, passage in rows:
            found = numbers(passage)
            starts += range(len(stream), len(stream) + len(found) - min_words + 1)
            stream += [*found, 0]
            owner += [item] * (len(found) + 1)
        self.stream, self.owner, self.starts, self.min_words = np.array(stream, np.int64), np.array(owner, np.int64), np.array(starts, np.int64), min_words


@dataclass
class Shard:
    """Documents as ``codes``: ranks of their words among ``words``, from 1, each document closed by a zero at ``ends``; and
    the suffixes in order. A document's close sorts below every word, the closes among each other by their place."""

    ids: list
    ends: np.ndarray
    words: np.ndarray
    codes: np.ndarray
    suffixes: np.ndarray

    @classmethod
    def of(cls, ids: list, ends: list[int], stream: list[int]) -> "Shard":
        words, codes = np.unique(np.array(stream, np.int64), return_inverse=True)
        # Each stream holds a zero, the close, which is the least number.
        return cls(ids, np.array(ends, np.int64), words[1:], codes.astype(np.int32), suffix_order(codes))

    def row(self) -> tuple:
        return self.ids, self.ends.tobytes(), self.words.tobytes(), self.codes.tobytes(), self.suffixes.tobytes()

    @classmethod
    def from_row(cls, ids: list, ends: bytes, words: bytes, codes: bytes, suffixes: bytes) -> "Shard":
        return cls(ids, np.frombuffer(ends, np.int64), np.frombuffer(words, np.int64), np.frombuffer(codes, np.int32), np.frombuffer(suffixes, np.int32))

    def search(self, passages: Passages) -> Iterator[tuple[int | None, int, int, int]]:
        """(document id, item, word at which the longest match starts, its words) for each pair that matches."""
        if not len(self.words):
            return
        at = np.searchsorted(self.words, passages.stream)
        known = (at < len(self.words)) & (self.words[np.minimum(at, len(self.words) - 1)] == passages.stream)
        # A word that the shard does not have, and a passage's close, equal nothing there.
        asked = np.append(np.where(known, at + 1, -1).astype(np.int32), np.int32(-1))
        gaps = np.concatenate([[0], np.cumsum(asked < 0)])
        size = passages.min_words
        starts = passages.starts[gaps[passages.starts + size] == gaps[passages.starts]]
        low, high = self._bounds(asked, starts, size)
        hits = high - low
        starts, low, hits = starts[hits > 0], low[hits > 0], hits[hits > 0]
        reach = np.cumsum(hits)
        best: list[np.ndarray] = []
        first = 0
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(reach, (reach[first - 1] if first else 0) + PAIRS, "right")))
            part = slice(first, last)
            best.append(self._longest(asked, starts[part], low[part], hits[part], passages))
            first = last
        if not best:
            return
        for doc, item, place, words in _least(np.concatenate(best, axis=1)).T:
            yield self.ids[doc], int(item), int(place), int(words)

    def _bounds(self, asked: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For each start the range of suffixes that begin with its ``size`` words."""
        closed = np.concatenate([self.codes, np.zeros(size, np.int32)])
        out = []
        for upper in (False, True):
            low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.suffixes), np.int64)
            while (open_ := low < high).any():
                middle = (low + high) // 2
                suffix = self.suffixes[np.minimum(middle, len(self.suffixes) - 1)].astype(np.int64)
                less, equal = np.zeros(len(starts), bool), np.ones(len(starts), bool)
                for k in range(size):
                    mine, theirs = asked[starts + k], closed[suffix + k]
                    less |= equal & (theirs < mine)
                    equal &= theirs == mine
                    if not equal.any():
                        break
                right = open_ & (less | (equal if upper else False))
                low, high = np.where(right, middle + 1, low), np.where(open_ & ~right, middle, high)
            out.append(low)
        return out[0], out[1]

    def _longest(self, asked: np.ndarray, starts: np.ndarray, low: np.ndarray, hits: np.ndarray, passages: Passages) -> np.ndarray:
        """document, item, word of the document, words: the longest match of each pair among these suffixes."""
        mine = np.repeat(starts, hits)
        theirs = self.suffixes[np.repeat(low, hits) + np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits)].astype(np.int64)
        length = np.full(len(mine), passages.min_words, np.int64)
        live = np.arange(len(mine))
        while len(live):
            live = live[asked[mine[live] + length[live]] == self.codes[theirs[live] + length[live]]]
            length[live] += 1
        doc = np.searchsorted(self.ends, theirs, "right")
        begin = np.concatenate([[0], self.ends])[doc]
        return _least(np.stack([doc, passages.owner[mine], theirs - begin, length]))


def _least(found: np.ndarray) -> np.ndarray:
    """Of each document and item the longest match, the first of them."""
    doc, item, place, words = found
    order = np.lexsort((place, -words, item, doc))
    found = found[:, order]
    new = np.ones(found.shape[1], bool)
    new[1:] = (found[:2, 1:] != found[:2, :-1]).any(axis=0)
    return found[:, new]


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """The starts of all suffixes in order, by prefix doubling; only suffixes that still tie are sorted again."""
    n = len(codes)
    closes = codes == 0
    # The closes differ from each other, so no comparison runs past one.
    first = np.where(closes, np.cumsum(closes) - 1, codes.astype(np.int64) + closes.sum())
    counts = np.bincount(first)
    rank = (np.cumsum(counts) - counts)[first]
    tied = np.flatnonzero(counts[first] > 1)
    step = 1
    while len(tied):
        mine, following = rank[tied], rank[tied + step]
        order = np.argsort(mine * n + following, kind="stable")
        tied, mine, following = tied[order], mine[order], following[order]
        place = np.arange(len(tied))
        group = np.ones(len(tied), bool)
        group[1:] = mine[1:] != mine[:-1]
        new = group.copy()
        new[1:] |= following[1:] != following[:-1]
        start = np.maximum.accumulate(np.where(group, place, 0))
        rank[tied] = mine + np.maximum.accumulate(np.where(new, place, 0)) - start
        again = ~new
        again[:-1] |= ~new[1:]
        tied = tied[again]
        step *= 2
    out = np.empty(n, np.int32)
    out[rank] = np.arange(n, dtype=np.int32)
    return out


def _shards(texts: Iterator[tuple[int | None, str | None]], min_words: int) -> Iterator[Shard]:
    numbers = Numbers()
    ids, ends, stream = [], [], []
    for key, text in texts:
        found = numbers(text)
        if len(found) < min_words:
            continue
        ids.append(key)
        stream += [*found, 0]
        ends.append(len(stream))
        if len(stream) >= SHARD_WORDS:
            yield Shard.of(ids, ends, stream)
            ids, ends, stream = [], [], []
    if stream:
        yield Shard.of(ids, ends, stream)


def search(passages: Passages, texts: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
    """(row of ``texts``, item, word at which the longest match starts, its words) for each pair that matches."""
    for shard in _shards(enumerate(texts), passages.min_words):
        yield from shard.search(passages)


def suffix_arrays(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The shards of the corpus, one a row; documents too short for a match are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        kinds = (pa.list_(pa.int64()), *[pa.binary()] * 4)
        for shard in _shards(texts, min_words):
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(shard.row(), kinds)], names=["ids", "ends", "words", "codes", "suffixes"])

    return documents.select("doc_id", "text").where(F.col("text").isNotNull()).mapInArrow(run, SHARD)


def leaked_passages(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, item_id, first_word, n_words: the longest run of words that a document shares with each passage.

    Words are the longest runs of letters or digits in lower case; what stands between them does not matter. Pairs with
    fewer than ``min_words`` words in a row give no row; null, empty and short texts or passages give none. Items
    without id are skipped. A repeated doc_id gives a row for each of its texts that matches. Passages travel in blocks of
    ``BLOCK_WORDS`` words. Where there is more than one, the suffix arrays are written once and the matches of each block
    are added to one table, so that neither the driver nor the plan grows with the passages.
    """
    spark = documents.sparkSession
    schema = "doc_id bigint, item_id bigint, first_word int, n_words int"
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())

    def searched(shards: DataFrame, block: list[tuple[int, str]]) -> tuple[DataFrame, object]:
        shared = spark.sparkContext.broadcast(Passages(block, min_words))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    found = list(Shard.from_row(*(c[row].as_py() for c in batch.columns)).search(shared.value))
                    columns = list(zip(*found)) if found else [[]] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "item_id", "first_word", "n_words"])

        return shards.mapInArrow(run, schema), shared

    blocks = _blocks(items)
    one, two = next(blocks, None), next(blocks, None)
    if one is None:
        return spark.createDataFrame([], schema)
    shards = suffix_arrays(documents, min_words)
    if two is None:
        return searched(shards, one)[0]
    shards, path = written(shards), f"{checkpoint_path(documents)}/{uuid.uuid4().hex}.parquet"
    for block in (one, two, *blocks):
        found, shared = searched(shards, block)
        found.write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.schema(schema).parquet(path)


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    block: list[tuple[int, str]] = []
    size = 0
    for row in items.where(F.col("passage").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "passage").toLocalIterator():
        block.append((row["item_id"], row["passage"]))
        size += len(row["passage"]) // 2
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Distinct doc_id, item_id of the documents that hold a passage in whole or in part."""
    return leaked_passages(documents, items, min_words).select("doc_id", "item_id").distinct()


def without_leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents in which no passage was found; documents with null id are kept."""
    return documents.join(leaks(documents, items, min_words).select("doc_id").distinct(), "doc_id", "left_anti")

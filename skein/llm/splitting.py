"""Problem 4: splitting oversized texts at natural boundaries by agglomerative merging."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, OVERLAP = 4000, 200
#: Boundary classes from the strongest to the weakest; a cut stands at the end of a match.
BOUNDARIES = (
    (4, re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)*\n")),
    (3, re.compile(r"\n|\r(?!\n)")),
    (2, re.compile(r"[.!?…。！？]+[\"'»”’)\]]*\s+")),
    (1, re.compile(r"\s+")),
)


def _atoms(text: str, start: int, end: int, room: int, level: int, out: list[tuple[int, int]]) -> None:
    """Append (end, class of the boundary at that end) of the segments of ``text[start:end]``.

    A stretch that fits is one segment from the start: all its inner boundaries are weaker than those at its ends, so
    merging the weakest first would join it again before anything else touches it.
    """
    if end - start <= room:
        out.append((end, 0))
        return
    if level == len(BOUNDARIES):
        for at in range(start + room, end, room):
            out.append((at, 0))
        out.append((end, 0))
        return
    rank, pattern = BOUNDARIES[level]
    at = start
    for match in pattern.finditer(text, start, end):
        if start < match.end() < end:
            _atoms(text, at, match.end(), room, level + 1, out)
            out[-1] = (match.end(), rank)
            at = match.end()
    _atoms(text, at, end, room, level + 1, out)


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """Offsets at which ``text`` is cut; empty if it has at most ``limit`` code points.

    The segments of the text and the boundaries between them stand in a heap; the weakest boundary, the leftmost of
    them, is merged while the union and the overlap before it fit the limit.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    if len(text) <= limit:
        return []
    room = limit - overlap
    atoms: list[tuple[int, int]] = []
    _atoms(text, 0, len(text), room, 0, atoms)
    ends = [e for e, _ in atoms]
    n = len(ends)
    starts = [0, *ends[:-1]]
    before = list(range(-1, n - 1))
    after = list(range(1, n + 1))
    alive = [True] * n
    version = [0] * n

    def fits(i: int) -> tuple[int, int] | None:
        j = after[i]
        size = ends[j] - starts[i]
        return (size, j) if size <= (limit if starts[i] == 0 else room) else None

    heap: list[tuple[int, int, int, int, int]] = []

    def push(i: int) -> None:
        if 0 <= i and after[i] < n and (found := fits(i)):
            rank = atoms_rank[i]
            heapq.heappush(heap, (rank, starts[i], found[0], i, version[i]))

    atoms_rank = [r for _, r in atoms]
    for i in range(n - 1):
        push(i)
    while heap:
        _, _, size, i, seen = heapq.heappop(heap)
        if not alive[i] or seen != version[i] or after[i] >= n or ends[after[i]] - starts[i] != size:
            continue
        j = after[i]
        alive[j] = False
        ends[i], atoms_rank[i], after[i] = ends[j], atoms_rank[j], after[j]
        if after[i] < n:
            before[after[i]] = i
        version[i] += 1
        push(i)
        if before[i] >= 0:
            version[before[i]] += 1
            push(before[i])
    return [ends[i] for i in range(n) if alive[i]][:-1]


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[str]:
    """The pieces of ``text``: each but the first starts with the last ``overlap`` code points of the one before."""
    marks = [0, *cuts(text, limit, overlap), len(text)]
    out: list[str] = []
    for a, b in zip(marks, marks[1:]):
        out.append((out[-1][-overlap:] if out and overlap else "") + text[a:b])
    return out


def cut_pages(pages: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, key: str = "page_id", text: str = "chunk") -> DataFrame:
    """key, cuts (array<int>) of the texts over the limit; null texts and texts that fit give no row."""
    schema = T.StructType([*pages.select(key).schema, T.StructField("cuts", T.ArrayType(T.IntegerType()))])
    over = pages.select(key, text).where(F.length(text) > limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [cuts(t, limit, overlap) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.list_(pa.int32()))], names=[key, "cuts"])

    return over.mapInArrow(run, schema)


def split_pages(pages: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """page_id, piece_no, start, piece: the pieces of every page with text.

    ``start`` is the offset of the piece's own text, after its overlap. A page that fits gives one piece, without leaving
    the JVM; a null or empty chunk gives none. The pieces without their overlaps give back the chunk.
    """
    schema = "page_id bigint, piece_no int, start int, piece string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, offsets, texts = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                marks = [0, *cuts(text, limit, overlap)]
                for no, (mark, piece) in enumerate(zip(marks, pieces(text, limit, overlap))):
                    ids.append(key), numbers.append(no), offsets.append(mark), texts.append(piece)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(offsets, pa.int32()), pa.array(texts, pa.string())],
                names=["page_id", "piece_no", "start", "piece"],
            )

    size = F.length("chunk")
    fit = pages.where((size > 0) & (size <= limit)).select("page_id", F.lit(0).alias("piece_no"), F.lit(0).alias("start"), F.col("chunk").alias("piece"))
    return fit.unionByName(pages.select("page_id", "chunk").where(size > limit).mapInArrow(run, schema))


def oversized(pages: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """page_id of the pages that the splitter had to cut."""
    return cut_pages(pages, limit, overlap).where(F.size("cuts") > 0).select("page_id")

"""Problem 6: encoding texts with a public byte-level BPE vocabulary, exactly and in linear time.

A piece of text (the pattern below cuts texts into pieces, as the vocabulary's authors do) is matched against the whole
vocabulary by one Aho-Corasick pass. The encoder then walks over it: take the longest token that starts here; keep it
if the pair with the token before it is one that the merges themselves would leave side by side; else try the next
shorter one; else step back. A sequence of tokens is what the merges produce exactly if each neighbouring pair is, and
whether a pair is, is remembered. Places where no encoding can stand are remembered too, so none is tried twice.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the vocabulary files lie; every function takes another folder.
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
# Fixed value: the published splitting pattern of this family of vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces of text whose ids a worker remembers; it forgets them all when there are more.
REMEMBERED = 200_000


class Encoder:
    """Encodes text with the ranks of one vocabulary file (lines of base64 token and rank)."""

    def __init__(self, ranks: bytes):
        import ahocorasick
        import regex

        rows = [line.split() for line in ranks.splitlines() if line.strip()]
        self.rank = {base64.b64decode(token): int(rank) for token, rank in rows}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.token = {rank: token for token, rank in self.rank.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, list[int]] = {}
        self.split = regex.compile(PATTERN).findall

    def merged(self, data: bytes) -> list[int]:
        """The merges themselves, for the two tokens of one pair."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.rank[p] for p in parts]

    def stand_together(self, left: int, right: int) -> bool:
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            found = self.pairs[(left, right)] = self.merged(self.token[left] + self.token[right]) == [left, right]
        return found

    def piece(self, data: bytes) -> list[int]:
        size = len(data)
        starting: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for end, (length, rank) in self.automaton.iter(data.decode("latin-1")):
            starting[end + 1 - length].append((length, rank))  # in order of length, as their ends are
        dead = bytearray(size + 1)
        path: list[tuple[int, int, int]] = []  # start, which of the tokens there, id
        at = 0
        choice = len(starting[0]) - 1 if size else -1
        while at < size:
            while choice >= 0:
                length, rank = starting[at][choice]
                if not dead[at + length] and (not path or self.stand_together(path[-1][2], rank)):
                    break
                choice -= 1
            if choice >= 0:
                path.append((at, choice, rank))
                at += length
                choice = len(starting[at]) - 1 if at < size else -1
            else:
                dead[at] = 1
                if not path:
                    raise ValueError("the vocabulary lacks single bytes")
                at, choice, _ = path.pop()
                choice -= 1
        return [rank for _, _, rank in path]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.pieces
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.piece(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out


_encoders: dict[int, Encoder] = {}


def encoder(ranks: bytes) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    key = hash(ranks)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks)
    return _encoders[key]


def load_ranks(vocabulary: str = VOCABULARY, folder: str = FOLDER) -> bytes:
    return (Path(folder) / f"{vocabulary}.tiktoken").read_bytes()


def encode_texts(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, folder: str = FOLDER) -> DataFrame:
    """key, ids: the token ids of every text, without special tokens.

    Null and empty texts give an empty list; strings that look like special tokens are ordinary text; repeated keys and
    texts give a row each. The vocabulary file (under 1 MB) is read once on the driver and broadcast.
    """
    shared = documents.sparkSession.sparkContext.broadcast(load_ranks(vocabulary, folder))
    schema = documents.select(key).schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                ids = [own.encode(t) if t else [] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return documents.select(key, text).mapInArrow(run, schema)

"""What models do, behind small interfaces, with deterministic offline stand-ins.

A prompt is an instruction, :data:`MARK`, and the material it is about; the stand-ins read the material only.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class Embedder(Protocol):
    """Turns a batch of texts into vectors."""

    width: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class HashEmbedder:
    """Hashed bag of words with signs, of length 1; a text without words is the zero vector."""

    width: int = 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        import zlib

        out = np.zeros((len(texts), self.width))
        for row, text in zip(out, texts):
            for word in re.findall(r"[^\W_]+", (text or "").lower()):
                h = zlib.crc32(word.encode())
                row[h % self.width] += 1 if h >> 31 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(size > 0, size, 1)).tolist()


class Answerer(Protocol):
    """Answers a question from a context."""

    def answer(self, question: str, context: str) -> str: ...


@dataclass(frozen=True)
class ExtractiveAnswerer:
    """The sentence of the context that shares most words with the question; the first on a tie."""

    def answer(self, question: str, context: str) -> str:
        asked = set(re.findall(r"\w+", (question or "").lower()))
        best = max(re.split(r"(?<=[.!?])\s+", context or ""), key=lambda s: len(asked & set(re.findall(r"\w+", s.lower()))), default="")
        return best.strip()


MARK = "\n---\n"


@dataclass(frozen=True)
class Reply:
    """What a model said, with the tokens it read and wrote."""

    text: str
    prompt_tokens: int = 0
    completion_tokens: int = 0


class Generator(Protocol):
    """A model that continues a prompt; it raises where it fails."""

    name: str

    def generate(self, prompt: str) -> Reply: ...


class Judge(Protocol):
    """A model that scores an answer against its question, expected answer and context, 0 to 1; it raises where it fails."""

    name: str

    def score(self, metric: str, question: str, answer: str, expected: str, context: str) -> float: ...


def word_tokens(text: str | None) -> int:
    """The token counter used where none is given."""
    return len((text or "").split())


@dataclass(frozen=True)
class Scripted:
    """A stand-in that turns the material of a prompt into a reply, with any token counter."""

    name: str
    reply: Callable[[str], str]
    counter: Callable[[str], int] = word_tokens

    def generate(self, prompt: str) -> Reply:
        text = self.reply(prompt.rsplit(MARK, 1)[-1])
        return Reply(text, self.counter(prompt), self.counter(text))


def fail(material: str) -> str:
    raise ConnectionError("no model is reachable")


def first_words(count: int) -> Callable[[str], str]:
    return lambda material: " ".join([w for w in re.split("[ \t\n\r\f]+", material) if w][:count])


def question_and_context(material: str) -> str:
    """Answers from JSON of question and context with the extractive stand-in."""
    asked = json.loads(material)
    return ExtractiveAnswerer().answer(asked["question"], asked["context"])


def fenced(value: object) -> str:
    return "```json\n" + json.dumps(value, ensure_ascii=False) + "\n```"


def pattern_triplets(pattern: str, kind: str = "RELATED_TO") -> Callable[[str], str]:
    """Triplets of the pattern's two or three groups (head, tail, or head, type, tail) as fenced JSON."""

    def reply(material: str) -> str:
        found = [m.groups() for m in re.finditer(pattern, material)]
        return fenced([{"head": g[0], "type": g[1] if len(g) > 2 else kind, "tail": g[-1]} for g in found])

    return reply


@dataclass(frozen=True)
class OverlapJudge:
    """Share of the terms of one side that the other has: of the question's for relevancy, of the expected answer's in the
    answer or context for the other metrics. Fails where a side is missing."""

    name: str = "overlap"

    def score(self, metric: str, question: str, answer: str, expected: str, context: str) -> float:
        wanted, given = (question, answer) if metric == "relevancy" else (expected, answer if metric == "precision" else context)
        if not wanted or not given:
            raise ValueError("nothing to judge")
        terms = set(re.findall("[a-z0-9]+", wanted.lower()))
        return len(terms & set(re.findall("[a-z0-9]+", given.lower()))) / max(1, len(terms))


#: Makers of generators by name, for those that come from a configuration.
REGISTRY: dict[str, Callable[[], Generator]] = {
    "unreachable": lambda: Scripted("unreachable", fail),
    "titles": lambda: Scripted("titles", first_words(8)),
    "answers": lambda: Scripted("answers", question_and_context),
}


def generator(name: str) -> Generator:
    if name not in REGISTRY:
        raise KeyError(f"no generator is registered under {name}")
    return REGISTRY[name]()


class Timer:
    """Seconds that a block of driver code took: ``with Timer() as t: ...; t.seconds``."""

    seconds = 0.0

    def __enter__(self) -> "Timer":
        self._began = time.perf_counter()
        return self

    def __exit__(self, *_: object) -> None:
        self.seconds = time.perf_counter() - self._began


# What stands in for a node without text.
EMPTY = {"chunk": "Empty chunk", "entity": "Unknown entity", "community": "Empty community"}


def embed_rows(rows: DataFrame, key: str, text: str, embedder: Embedder, kind: str = "chunk", name: str = "embedding", skip_failed: bool = False, size: int = 32) -> DataFrame:
    """key and vector of each row, ``size`` texts a call; null and empty texts are embedded as the stand-in.

    With ``skip_failed`` the rows of a call that raises get a null vector; else the error ends the job.
    """
    from pyspark.sql import types as T

    schema = rows.select(key).schema.add(name, T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t and t.strip() else EMPTY[kind] for t in batch.column(1).to_pylist()]
            vectors: list = []
            for i in range(0, len(texts), size):
                try:
                    vectors += embedder.embed(texts[i : i + size])
                except Exception:
                    if not skip_failed:
                        raise
                    vectors += [None] * len(texts[i : i + size])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float64()))], names=[key, name])

    return rows.select(key, text).mapInArrow(run, schema)


def names_in(question: str, known: DataFrame, column: str = "title", limit: int = 6) -> DataFrame:
    """The known names that stand in the question, longest first, lower case: the offline entity extraction."""
    from pyspark.sql import functions as F

    low = F.lower(F.col(column))
    return known.select(low.alias("name")).where((F.length("name") > 1) & F.contains(F.lit(question.lower()), F.col("name"))).distinct().orderBy(F.desc(F.length("name")), "name").limit(limit)

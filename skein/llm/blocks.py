"""Problem 2: the main body of a page, told from its boilerplate by a bidirectional LSTM over its blocks.

The blocks of a page are its non-blank lines in order. Each is read as a tag path (what the line is in the page's
markup, and whether blank lines stand around it), a hashed-word vector and a few figures; one LSTM reads the sequence
forwards, one backwards, and every block is classified from both states, so that what stands far before and after it
counts too. ``train_blocks`` trains the weights, which lie beside this module; numpy runs the network.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WEIGHTS = Path(__file__).with_name("block_lstm.npz")
BITS, WIDTH, TAG_WIDTH, HIDDEN, FIGURES = 13, 16, 8, 24, 12
KINDS = 12
TAGS = KINDS * 9
#: Blocks that the network takes at once.
STEP_BLOCKS = 60_000

_word = re.compile(r"[^\W_]+").findall
_host = re.compile(r"^(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)[^/?#]*(?:/(?:[^?#]*/)?([^/?#]+)/?)?")
_link = re.compile(r"\[([^\]]*)\]\(([^)]*)\)")
_end = re.compile(r"[.!?…][\"'”’»)\]]*$")


def kind_of(line: str) -> int:
    """The line's own part of its tag path."""
    first = line[0]
    if first == "#":
        return 1 if line.startswith("# ") else 2 if line.startswith("## ") else 3
    if first == "|":
        return 4
    if first in "*-•+" and line[1:2] in (" ", "\t"):
        rest = line[2:].lstrip()
        found = _link.match(rest)
        return 5 if found and found.end() == len(rest) else 6
    if line.startswith("**") and line.endswith("**") and len(line) > 4:
        return 7
    if first == "[":
        found = _link.match(line)
        if found and found.end() == len(line):
            return 8
    if " | " in line or " · " in line or " > " in line:
        return 9
    return 10 if len(line) > 60 and _end.search(line) else 11


class Reader:
    """Turns pages into the arrays that the network reads; remembers the numbers of words."""

    def __init__(self) -> None:
        import zlib

        self.crc = zlib.crc32
        self.known: dict[str, int] = {}

    def number(self, word: str) -> int:
        if len(self.known) > 300_000:
            self.known.clear()
        low = word.lower()
        key = "0" if low.isdigit() else low
        found = self.known[word] = 3 + self.crc(key.encode("utf-8", "surrogatepass")) % ((1 << BITS) - 3)
        return found

    def page(self, chunk: str, url: str | None) -> tuple[list[int], list[int], list[list[int]], np.ndarray]:
        """Line numbers, tag paths, word numbers and figures of the blocks of one page."""
        raw = chunk.split("\n")
        lines, places = [], []
        for i, line in enumerate(raw):
            line = line.strip()
            if line:
                lines.append(line)
                places.append(i)
        n = len(lines)
        figures = np.zeros((n, FIGURES), np.float32)
        if not n:
            return [], [], [], figures
        found = _host.match((url or "").lower())
        site = {w for w in re.split(r"[^a-z0-9]+", found.group(1).rpartition(".")[0]) if len(w) > 3}
        slug = re.sub(r"-\d+$", "", found.group(2) or "")
        subject = " ".join(_word(slug)) if re.search("[a-z]", slug) else ""
        tags, words = [], []
        get, number = self.known.get, self.number
        last = places[-1]
        for k, line in enumerate(lines):
            at = places[k]
            before = 2 if k == 0 else min(2, at - places[k - 1] - 1)
            after = 2 if k == n - 1 else min(2, places[k + 1] - at - 1)
            kind = kind_of(line)
            tags.append((kind * 3 + before) * 3 + after)
            own = _word(line)
            low = line.lower()
            ids = [get(w) or number(w) for w in own]
            named = bool(subject) and (subject in low or subject in " ".join(own).lower())
            sited = any(s in low for s in site)
            if named:
                ids.append(1)
            if sited:
                ids.append(2)
            words.append(ids or [0])
            size = len(line)
            row = figures[k]
            row[0] = np.log1p(size) / 6
            row[1] = np.log1p(len(own)) / 5
            row[2] = named
            row[3] = sited
            row[4] = bool(_end.search(line))
            row[5] = line.isupper()
            row[6] = any(c.isdigit() for c in line) if size < 400 else 1
            row[7] = at / (last + 1)
            row[8] = min(k, 10) / 10
            row[9] = min(n - 1 - k, 10) / 10
            row[10] = bool(subject)
            row[11] = "](" in line
        return places, tags, words, figures


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(np.minimum(x, 60, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Network:
    """The trained network, forward only."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: np.asarray(v, np.float32) for k, v in weights.items()}

    @classmethod
    def load(cls, path: Path = WEIGHTS) -> "Network":
        with np.load(path) as found:
            return cls({k: found[k] for k in found.files})

    def inputs(self, tags: np.ndarray, words: np.ndarray, starts: np.ndarray, figures: np.ndarray) -> np.ndarray:
        counts = np.diff(np.append(starts, len(words)))
        bag = np.add.reduceat(self.w["words"][words], starts, axis=0) / np.sqrt(counts)[:, None].astype(np.float32)
        return np.concatenate([bag, self.w["tags"][tags], figures], axis=1)

    def direction(self, x: np.ndarray, mask: np.ndarray, name: str, back: bool) -> np.ndarray:
        """States (time, page, hidden) of one direction; x is (time, page, input)."""
        steps, pages, _ = x.shape
        recur = self.w[f"u{name}"]
        gates = x @ self.w[f"w{name}"] + self.w[f"b{name}"]
        h = np.zeros((pages, HIDDEN), np.float32)
        c = np.zeros((pages, HIDDEN), np.float32)
        out = np.empty((steps, pages, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1) if back else range(steps):
            z = gates[t] + h @ recur
            gate = _sigmoid(z[:, : 3 * HIDDEN])
            c = (gate[:, HIDDEN : 2 * HIDDEN] * c + gate[:, :HIDDEN] * np.tanh(z[:, 3 * HIDDEN :])) * mask[t]
            h = gate[:, 2 * HIDDEN :] * np.tanh(c)
            out[t] = h
        return out

    def score(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Margin of every block for being outside the main body; x holds the blocks of the pages one after another."""
        steps = int(sizes.max())
        padded = np.zeros((steps, len(sizes), x.shape[1]), np.float32)
        page = np.repeat(np.arange(len(sizes)), sizes)
        step = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        padded[step, page] = x
        mask = (np.arange(steps)[:, None] < sizes[None, :]).astype(np.float32)[:, :, None]
        ahead = self.direction(padded, mask, "f", False)[step, page]
        behind = self.direction(padded, mask, "r", True)[step, page]
        return np.concatenate([ahead, behind, x], axis=1) @ self.w["out"] + self.w["bias"]

    def label(self, reader: Reader, chunks: list[str | None], urls: list[str | None]) -> Iterator[tuple[int, list[int], np.ndarray]]:
        """(index, line numbers, margins) of each page with a block, in any order."""
        pages = [(i, *reader.page(c, u)) for i, (c, u) in enumerate(zip(chunks, urls)) if c and not c.isspace()]
        pages.sort(key=lambda p: len(p[1]))
        at = 0
        while at < len(pages):
            end = at
            while end < len(pages) and (end == at or (end - at + 1) * len(pages[end][1]) <= STEP_BLOCKS):
                end += 1
            group = pages[at:end]
            at = end
            bags = [w for p in group for w in p[3]]
            starts = np.cumsum([0] + [len(w) for w in bags[:-1]])
            words = np.fromiter((w for bag in bags for w in bag), np.int64)
            x = self.inputs(np.array([t for p in group for t in p[2]]), words, starts, np.concatenate([p[4] for p in group]))
            margins = self.score(x, np.array([len(p[1]) for p in group]))
            first = 0
            for i, places, *_ in group:
                yield i, places, margins[first : first + len(places)]
                first += len(places)


#: The network that the worker used last, with the digest of its weights.
_loaded: dict[bytes, tuple[Network, Reader]] = {}


def _network(weights: bytes) -> tuple[Network, Reader]:
    import hashlib
    import io

    key = hashlib.sha256(weights).digest()
    if key not in _loaded:
        _loaded.clear()
        with np.load(io.BytesIO(weights)) as found:
            _loaded[key] = Network({k: found[k] for k in found.files}), Reader()
    return _loaded[key]


def block_labels(pages: DataFrame, weights: Path = WEIGHTS) -> DataFrame:
    """page_id, line_no, outside (whether the block is outside the main body), margin: one row for each non-blank line.

    Null, empty and blank chunks give no row; pages without URL are read without a site and a subject.
    """
    shared = pages.sparkSession.sparkContext.broadcast(weights.read_bytes())
    schema = "page_id bigint, line_no int, outside boolean, margin float"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, reader = _network(shared.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                ids = batch.column(0).to_pylist()
                keys, places, margins = [], [], []
                for i, own, found in network.label(reader, batch.column(2).to_pylist(), batch.column(1).to_pylist()):
                    keys += [ids[i]] * len(own)
                    places += own
                    margins.append(found)
                margin = np.concatenate(margins) if margins else np.empty(0, np.float32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(places, pa.int32()), pa.array(margin > 0), pa.array(margin, pa.float32())],
                    names=["page_id", "line_no", "outside", "margin"],
                )

    return pages.select("page_id", "url", "chunk").mapInArrow(run, schema)


def boilerplate_lines(pages: DataFrame) -> DataFrame:
    """page_id, line_no of the non-blank lines outside the main body."""
    return block_labels(pages).where("outside").select("page_id", "line_no")


def main_bodies(pages: DataFrame, weights: Path = WEIGHTS) -> DataFrame:
    """page_id, chunk: the main body of each page, without shuffle; null stays null, a page without a body gives ''."""
    shared = pages.sparkSession.sparkContext.broadcast(weights.read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, reader = _network(shared.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                chunks = batch.column(2).to_pylist()
                out = [None if c is None else "" for c in chunks]
                for i, own, found in network.label(reader, chunks, batch.column(1).to_pylist()):
                    gone = {p for p, m in zip(own, found) if m > 0}
                    out[i] = re.sub(r"\n{3,}", "\n\n", "\n".join(x for k, x in enumerate(chunks[i].split("\n")) if k not in gone)).strip("\n")
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["page_id", "chunk"])

    return pages.select("page_id", "url", "chunk").mapInArrow(run, "page_id bigint, chunk string")

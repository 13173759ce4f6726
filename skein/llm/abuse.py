"""Problem 8: abusive, hateful or sexual content, graded by cumulative-link ordinal regression.

A document is a bag of passages (lines cut at sentence ends). One weight vector over hashed words and word pairs is
shared by all ordered thresholds: P(grade >= k) = sigmoid(w.x - theta_k). The labels are those of whole documents, so
training alternates between fitting and choosing, in each document with a bad verdict, the passage that scores highest
as the one the reviewer meant.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Grades in the order of severity; verdicts that are not listed (null, unknown) are no labels.
GRADES = ("none", "abusive", "hateful", "sexual")
#: Bound of the labelled sample that is brought to the driver for training.
MAX_LABELS = 20_000
#: Bound of the sample of other documents that shows the model what ordinary text looks like, and what one of its
#: passages weighs against one of a labelled document.
MAX_BACKGROUND = 10_000
BACKGROUND_WEIGHT = 0.03
BITS = 18
#: Weight that the marks of the stem list have before any label is seen; the weights of words start from 0.
PRIOR = 3.0
#: Strength of that prior belief, as for one over so many documents with a bad verdict; the more there are, the less it counts.
STRENGTH = 0.25
#: Steps of the fit in each turn; every turn goes on from the one before.
STEPS = (60, 20, 20, 20, 30)
THRESHOLD = 0.4

# Stems of abusive, hating and explicit words in four languages, as features for the model to weigh.
LEXICON = {
    "~abuse": "fuck motherfuck shit bullshit dipshit dumbass asshole arsehole jackass bastard bitch cunt scumbag moron idiot imbecile imbécil retard loser crétin cretin connard connasse salaud salope abruti ordure enculé putain merde débile arschloch wichser hurensohn scheiß scheiss dummkopf vollidiot drecksack mistkerl schwachkopf trottel gilipollas cabrón pendejo hijoputa mierda estúpido idiota puta capullo".split(),
    "~harm": "kill choke strangle rot drown crever crève verreck pudras muérete hang stab".split(),
    "~hate": "vermin vermine ungeziefer sabandija alimaña subhuman untermensch parasites cockroach".split(),
    "~sex": "porn porno hardcore xxx nude nudes naked nackt nus desnud horny geil cachond orgasm orgasme orgasmo blowjob cock pussy tits dick fick baisé baiser follar follaron masturb erotic erotik".split(),
}
LEET = str.maketrans("4310578@$!€", "aeiostbasie")

_word = re.compile(r"[^\W_][^\W_@$!*€]*(?:[@$!*€'’]+[^\W_]+)*", re.U)
_cut = re.compile(r"\n+|(?<=[.!?…])\s+")
_spaced = re.compile(r"(?<![^\W_])(?:[^\W_\d][ .\-_*]{1,2}){3,}[^\W_\d](?![^\W_])")
_gap = re.compile(r"[ .\-_*]+")
_speaker = re.compile(r"^\s*(?:\[[^\]]*\]\s*|[^\W_]+\d+:\s*)")
_run = re.compile(r"(.)\1{2,}")
_invisible = re.compile(r"[­​-‏ -‮⁠-⁤︀-️﻿]")


def plain(text: str) -> str:
    """Compatibility forms, no invisible or combining marks where they hide letters, spaced-out words joined."""
    text = _invisible.sub("", unicodedata.normalize("NFKC", text))
    return _spaced.sub(lambda m: _gap.sub("", m.group()), text)


def passages(text: str) -> list[str]:
    return [p for p in (_speaker.sub("", s) for s in _cut.split(plain(text))) if p.strip()]


def undisguise(word: str) -> str:
    """A word in lower case, with digits and signs that stand for letters put back; plain numbers become ``0``."""
    letters = sum(c.isalpha() for c in word)
    digits = sum(c.isdigit() for c in word)
    if not letters or digits and (digits >= 4 or digits > 2 * letters or word.rstrip("0123456789").isalpha() and digits > 1):
        return "0"
    word = word.lower().replace("’", "'")
    if digits or not word.isalpha():
        word = word.translate(LEET).replace("*", "")
    return _run.sub(r"\1", word)


class Hasher:
    """Numbers of words, remembered by each worker."""

    def __init__(self, bits: int = BITS):
        import xxhash

        self.mask = (1 << bits) - 1
        self.hash = xxhash.xxh3_64_intdigest
        self.known: dict[str, tuple[int, ...]] = {}
        self.stems = [(s, mark) for mark, stems in LEXICON.items() for s in stems]

    def numbers(self, raw: str) -> tuple[int, ...]:
        """The word's number first, then those of the lexicon marks it carries."""
        found = self.known.get(raw)
        if found is None:
            if len(self.known) > 300_000:
                self.known.clear()
            word = undisguise(raw)
            marks = {mark for s, mark in self.stems if word.startswith(s) and (len(s) > 4 or len(word) <= len(s) + 3)}
            found = self.known[raw] = tuple(self.hash(w) & self.mask for w in (word, *sorted(marks)))
        return found

    def features(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature numbers, the passage each belongs to, and the text each passage belongs to."""
        words: list[int] = []
        owner: list[int] = []
        extra: list[int] = []
        extra_owner: list[int] = []
        text_of: list[int] = []
        for t, text in enumerate(texts):
            if not text:
                continue
            for p in passages(text):
                k = len(text_of)
                text_of.append(t)
                for raw in _word.findall(p):
                    first, *marks = self.numbers(raw)
                    words.append(first)
                    owner.append(k)
                    for m in marks:
                        extra.append(m)
                        extra_owner.append(k)
        w, o = np.array(words, np.int64), np.array(owner, np.int64)
        pairs = ((w[:-1] * 1_000_003) ^ (w[1:] * 7_919 + 12_345)) & self.mask
        inside = o[:-1] == o[1:]
        return (
            np.concatenate([w, pairs[inside], np.array(extra, np.int64)]),
            np.concatenate([o, o[:-1][inside], np.array(extra_owner, np.int64)]),
            np.array(text_of, np.int64),
        )


@dataclass
class Ordinal:
    """Shared weights and ordered thresholds."""

    weights: np.ndarray
    cuts: np.ndarray

    def at_least(self, margin: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each threshold, one row a passage."""
        return 1 / (1 + np.exp(-np.clip(margin[:, None] - self.cuts, -40, 40)))


def _fit(feature: np.ndarray, owner: np.ndarray, n: int, grade: np.ndarray, weight: np.ndarray, start: Ordinal, prior: np.ndarray, l2: float, steps: int) -> Ordinal:
    """Full-batch Adam on the cumulative-link likelihood, each threshold as a logistic with the shared margin."""
    size, levels = len(prior), len(GRADES) - 1
    w, cuts = start.weights, start.cuts
    target = grade[:, None] >= np.arange(1, levels + 1)
    m, v = np.zeros(size + levels), np.zeros(size + levels)
    total = weight.sum()
    for t in range(1, steps + 1):
        margin = np.bincount(owner, w[feature], n)
        error = (1 / (1 + np.exp(-np.clip(margin[:, None] - cuts, -40, 40))) - target) * weight[:, None]
        gradient = np.concatenate([np.bincount(feature, error.sum(1)[owner], size) / total + l2 * (w - prior), -error.sum(0) / total])
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w = w - step[:size]
        cuts = np.sort(cuts - step[size:])
    return Ordinal(w, cuts)


def train(texts: list[str], verdicts: list[str], background: list[str] = (), bits: int = BITS) -> Ordinal:
    """A model from labelled documents and ordinary ones; see :func:`train_features`."""
    grades = np.array([GRADES.index(v) for v in verdicts] + [0] * len(background), np.int64)
    return train_features(*Hasher(bits).features([*texts, *background]), grades, np.arange(len(grades)) < len(texts), bits)


def train_features(feature: np.ndarray, owner: np.ndarray, text_of: np.ndarray, grades: np.ndarray, labelled: np.ndarray, bits: int = BITS) -> Ordinal:
    """A model from the features of documents with a grade; with no bad verdict it scores everything zero.

    Documents that are not ``labelled`` show what is ordinary. Their passages count a little as harmless until they look
    bad; those that look clearly bad teach nothing.
    """
    n = len(text_of)
    if not n or not grades.any():
        return Ordinal(np.zeros(1 << bits), np.full(len(GRADES) - 1, 40.0))
    hasher, prior = Hasher(bits), np.zeros(1 << bits)
    prior[[hasher.hash(mark) & hasher.mask for mark in LEXICON]] = PRIOR
    l2 = STRENGTH / (grades > 0).sum()
    own = grades[text_of]
    sizes = np.bincount(text_of, minlength=len(grades))[text_of]
    base = np.where(labelled[text_of], 1.0, BACKGROUND_WEIGHT)
    grade, weight = own, np.where(own > 0, 1.0 / sizes, base)
    model = Ordinal(prior, np.linspace(2.0, 5.0, len(GRADES) - 1))
    for turn, steps in enumerate(STEPS):
        model = _fit(feature, owner, n, grade, weight, model, prior, l2, steps)
        if turn == len(STEPS) - 1:
            break
        margin = np.bincount(owner, model.weights[feature], n)
        best = np.full(len(grades), -np.inf)
        np.maximum.at(best, text_of, margin)
        meant = (own > 0) & (margin >= best[text_of] - 1e-9)
        # Verdicts can be wrong: where even the best passage looks harmless, the label is left out.
        doubtful = (own > 0) & (best[text_of] < model.cuts[0] - 2.0) if turn else np.zeros(n, bool)
        # A passage that looks bad in a document without a bad verdict is left out too, the sooner without any verdict.
        # Ordinary text is mostly harmless, so no more than its worst fiftieth is.
        usual = np.quantile(margin[base < 1], 0.98) if (base < 1).any() else np.inf
        missed = (own == 0) & (margin > np.where(base < 1, max(model.cuts[0] - 2.0, usual), model.cuts[0] + 2.0))
        # What else stands in a bad document may be bad or not, and the other documents show enough that is not.
        also = (own > 0) & ~meant & (margin < model.cuts[0])
        meant |= (own > 0) & (margin >= model.cuts[0])
        grade = np.where(meant, own, 0)
        weight = np.where(doubtful | missed | also, 0.0, base)
    return model


def _sample(rows: DataFrame, keys: list[str], bound: int) -> DataFrame:
    """About ``bound`` rows at most, chosen by a hash of their keys; all rows if there are fewer."""
    share = min(1.0, bound / max(1, rows.count()))
    return rows if share == 1.0 else rows.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 32)) < int(share * (1 << 32)))


def training_features(documents: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, max_background: int = MAX_BACKGROUND) -> tuple[np.ndarray, ...]:
    """The arguments of :func:`train_features`: the usable labels and documents without one, each within its bound.

    Words become numbers where the documents are read; what comes to the driver are those of the sample only.
    """
    usable = labels.where(F.col("verdict").isin(*GRADES)).select("doc_id", "reviewer", "verdict").distinct()
    chosen = _sample(usable, ["doc_id", "reviewer"], max_labels)
    texts = documents.select("doc_id", "text").where(F.length("text") > 0)
    grade = F.array_position(F.array(*map(F.lit, GRADES)), F.col("verdict")) - 1
    judged = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", grade.alias("grade"), F.lit(True).alias("labelled"))
    others = _sample(texts, ["doc_id"], max_background).join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_anti")
    rows = judged.unionByName(others.select("doc_id", "text", F.lit(0).cast("bigint").alias("grade"), F.lit(False).alias("labelled")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hasher = Hasher()
        for batch in batches:
            parts = []
            for text in batch.column(1).to_pylist():
                feature, owner, text_of = hasher.features([text])
                order = np.argsort(owner, kind="stable")
                parts.append((feature[order].astype(np.int32).tobytes(), np.bincount(owner, minlength=len(text_of)).astype(np.int32).tobytes(), xxhash.xxh3_64_intdigest(text) >> 1))
            columns = [batch.column(0), batch.column(2), batch.column(3), *(pa.array([p[k] for p in parts], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "grade", "labelled", "features", "sizes", "digest"])

    found = rows.mapInArrow(run, "doc_id bigint, grade bigint, labelled boolean, features binary, sizes binary, digest bigint").collect()
    found.sort(key=lambda r: (not r["labelled"], r["doc_id"] is None, r["doc_id"] or 0, r["grade"], r["digest"]))
    sizes = [np.frombuffer(r["sizes"], np.int32) for r in found]
    each = np.concatenate([*sizes, np.empty(0, np.int32)])
    feature = np.concatenate([*(np.frombuffer(r["features"], np.int32) for r in found), np.empty(0, np.int32)])
    return (
        feature.astype(np.int64), np.repeat(np.arange(len(each)), each), np.repeat(np.arange(len(found)), [len(s) for s in sizes]),
        np.array([r["grade"] for r in found], np.int64), np.array([r["labelled"] for r in found], bool),
    )


def fit_model(documents: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, max_background: int = MAX_BACKGROUND) -> Ordinal:
    """One model for any number of scorings."""
    return train_features(*training_features(documents, labels, max_labels, max_background))


def score_documents(documents: DataFrame, labels: DataFrame | None, max_labels: int = MAX_LABELS, model: Ordinal | None = None) -> DataFrame:
    """doc_id, source, p_bad, severity: one row for each document.

    ``p_bad`` is the probability that the worst passage is at least abusive, ``severity`` its expected grade (0 to 3).
    Null, empty and blank texts score 0. Labels that are null, unknown or of documents without text are ignored; with
    no labels at all every score is 0. Repeated documents get a row each. With ``model`` nothing is trained.
    """
    if model is None:
        model = fit_model(documents, labels, max_labels)
    shared = documents.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.cuts))
    schema = documents.select("doc_id", "source").schema.add("p_bad", "double").add("severity", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, cuts = shared.value
        own, hasher = Ordinal(weights, cuts), Hasher()
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                feature, owner, text_of = hasher.features(batch.column(2).to_pylist())
                worst = np.full(batch.num_rows, -np.inf)
                np.maximum.at(worst, text_of, np.bincount(owner, weights[feature], len(text_of)))
                chance = np.where(np.isfinite(worst)[:, None], own.at_least(np.where(np.isfinite(worst), worst, -40.0)), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(chance[:, 0]), pa.array(chance.sum(1))],
                    names=["doc_id", "source", "p_bad", "severity"],
                )

    return documents.select("doc_id", "source", "text").mapInArrow(run, schema)


def bad_documents(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id of the documents whose worst passage is more likely bad than not."""
    return score_documents(documents, labels).where(F.col("p_bad") >= threshold).select("doc_id")


def source_rates(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """source, documents, bad, rate, mean_severity: one row for each source, null sources together."""
    return (
        score_documents(documents, labels)
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("p_bad") >= threshold).alias("bad"), F.avg("severity").alias("mean_severity"))
        .withColumn("rate", F.col("bad") / F.col("documents"))
    )

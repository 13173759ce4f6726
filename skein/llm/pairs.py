"""Problem 3: broken prompt and response pairs, each with the type of its defect."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from skein.llm.minhash import text_classes
from skein.session import checkpoint

FIELDS = ("actual_output", "expected_output")
MIN_PROMPTS = 2
#: The other answer of the record bears a sound recurring answer out at least once in so many times.
RARELY = 4
#: A text that stops without an end mark is a short answer up to so many words, and breaks off beyond.
SHORT_WORDS = 5

# What stands in for no answer.
STAND_INS = set("na n/a none null nil nan empty blank answer response no answer no response not available not applicable unknown tbd todo undefined keine antwort sin respuesta pas de réponse sans réponse aucune réponse réponse antwort respuesta".split()) | {
    "no answer", "no response", "not available", "not applicable", "keine antwort", "sin respuesta", "pas de réponse", "sans réponse", "aucune réponse",
}
# What a refusal says, in four languages; for refusals that do not recur, and as seeds of small classes.
CUES = re.compile(
    r"\b(?:i|we)(?:'m| am| are|'re)? (?:sorry|afraid|unable|not able|not permitted|not allowed|must decline|have to decline|would rather not|'d rather not|will not|won't|cannot|can't|can not|could not|couldn't|do not know|don't know|do not have|don't have|am an ai)\b"
    r"|\bnot able to (?:give|answer|help|provide)|\bas an? (?:ai|language model|assistant)\b|\bi (?:decline|refuse)\b|\bsorry, (?:but )?(?:i|we|no)\b|\b(?:outside|beyond) (?:of )?what i can\b"
    r"|\b(?:context|passage|text|document|source)s? (?:does not|doesn't|do not|did not) (?:contain|mention|include|provide|say)|\bno information (?:about|on|is available)|\bcannot (?:help|answer|assist)"
    r"|\bne (?:peux|puis|saurais|pouvons) pas|\bm'est impossible|\bimpossible (?:de|pour moi de) (?:répondre|donner)|\b(?:je suis )?désolée?\b|\bne (?:contient|mentionne|fournit) (?:aucune|pas|rien)|\bje ne sais pas|\baucune information"
    r"|\bkann ich (?:leider )?(?:nicht|keine)|\bich kann (?:\w+ ){0,3}(?:nicht|keine)|\bkeine auskunft|\btut mir leid|\bleider (?:nicht|kann|keine)|\bnicht beantworten|\b(?:enthält|nennt|liefert) (?:keine|nichts)|\bweiß (?:ich )?(?:es )?nicht"
    r"|\bno puedo\b|\blo siento\b|\bno (?:es posible|me es posible|sé|dispongo|tengo)\b|\bno (?:contiene|menciona|incluye|ofrece) (?:información|ningún|nada|datos)|\blamento\b|\bno podemos\b",
    re.I,
)
# Common function words by language.
WORDS = {
    "en": "the of and to in is it that for on with as at by from this an was are be has which its their than how what when where who why does did can while before after between into there over around takes below above no yes because so but not".split(),
    "fr": "le la les des du un une et est en que qui dans pour sur par au aux ne pas plus ce se sont son sa ses avec sous entre comme une selon près depuis ont été où quelle quel combien autour dure cette aucune malgré du côté qu".split(),
    "de": "der die das und den dem des ein eine einer eines einen ist von mit zu auf für im nicht sich auch aus bei nach wird wurde wurden über um wie wer was zwischen dass durch nur am vom zum zur hat haben braucht unter bis als sind eines hoch lange".split(),
    "es": "el los las una y es por con para del se su al lo como más no sus ha en de que la un entre según desde fue fueron cuál cuánto quién está sobre hasta sin cerca este esta son tarda dar pese durante".split(),
}
LANGUAGES = {w: {k for k, v in WORDS.items() if w in v} for ws in WORDS.values() for w in ws}

_words = re.compile(r"[^\W\d_]+").findall
_numbers = re.compile(r"\d[\d.,]*\d|\d").findall
_quoted = re.compile(r"\"[^\"\n]*(?:\"|$)|“[^”\n]*(?:”|$)|«[^»\n]*(?:»|$)|„[^“”\n]*(?:[“”]|$)")
_bare = re.compile(r"[\W_]+")
_label = re.compile(r"^\W*(?:question|query|prompt|q|frage|pregunta|answer|antwort|respuesta|réponse)\s*:\s*", re.I)
_sentences = re.compile(r"(?<=[.!?])\s+").split
_parts = re.compile(r"[\w'’\-]+").findall
_digit = re.compile(r"\d").search
_end = re.compile(r"[.!?。！？][\"'”’»)\]*_]*$")
_off = re.compile(r"(?:\.\.\.|…|[,;:(\[\-–—/])[\"'”’»*_]*$")


def language(text: str) -> tuple[str | None, int, dict[str, int]]:
    """The language whose function words stand most often in the text, how often, and all counts; None on a tie."""
    counts = dict.fromkeys(WORDS, 0)
    for word in _words(text.lower()):
        for k in LANGUAGES.get(word, ()):
            counts[k] += 1
    ranked = sorted(counts.values(), reverse=True)
    if ranked[0] == ranked[1]:
        return None, ranked[0], counts
    return max(counts, key=counts.get), ranked[0], counts


def _same(text: str) -> str:
    return _bare.sub(" ", text.lower()).strip()


def is_empty(text: str | None) -> bool:
    if text is None or not text.strip():
        return True
    bare = _same(text)
    return not bare or bare in STAND_INS or text.strip().lower() in STAND_INS


def is_copy(text: str, query: str | None) -> bool:
    """The text is the question, once or more, and nothing else but quotes, marks or a label."""
    asked = _same(query or "")
    given = _same(_label.sub("", text))
    if not asked or not given.startswith(asked):
        return False
    return not given.replace(asked, "").strip()


def breaks_off(text: str) -> bool:
    text = text.rstrip()
    size = len(text.split())
    if _off.search(text):
        return size > 1
    return not _end.search(text) and size > SHORT_WORDS


def other_language(text: str, query: str | None) -> bool:
    """The text's own words, without quotations, are clearly of another language than the question's."""
    if not query:
        return False
    asked = _asked_language(query)
    given, n, counts = language(_quoted.sub(" ", text))
    return asked is not None and given is not None and given != asked and n >= 2 and n >= 2 * counts[asked]


@lru_cache(10_000)
def _asked_words(query: str) -> frozenset[str]:
    return frozenset(re.findall(r"\w+", query))


@lru_cache(10_000)
def _template(query: str) -> str:
    return opening(query, query)


def opening(text: str, query: str | None) -> str:
    """The first sentence with its names and numbers masked, lower case."""
    first = _sentences(text.strip(), 1)[0]
    asked = _asked_words(query or "")
    out: list[str] = []
    for i, word in enumerate(_parts(first)):
        masked = _digit(word) or (word[:1].isupper() and (i > 0 or word in asked) and len(word) > 1)
        word = "_" if masked else word.lower().replace("’", "'")
        if word != "_" or not out or out[-1] != "_":
            out.append(word)
    return " ".join(out)


@lru_cache(10_000)
def _asked_numbers(query: str) -> frozenset[str]:
    return frozenset(_numbers(query))


@lru_cache(10_000)
def _asked_language(query: str) -> str | None:
    return language(query)[0]


def _cued(text: str) -> bool:
    return bool(CUES.search(text.replace("’", "'")))


def answers_something(text: str, query: str | None, past_opening: bool = False) -> bool:
    """The text names a number that the question doesn't, or says much in sentences that carry no refusal's words.

    With ``past_opening`` the first sentence counts for nothing but its numbers.
    """
    asked = _asked_numbers(query or "")
    if any(n not in asked for n in _numbers(text)):
        return True
    said = _sentences(text.strip())[1 if past_opening else 0 :]
    return sum(len(s.split()) for s in said if not _cued(s)) > 8


def _content(text: str) -> set[str]:
    return {w for w in _words(text.lower()) if len(w) > 2 and w not in LANGUAGES}


class _Answer:
    """What one answer says, worked out once for itself and for the record's other answer."""

    def __init__(self, text: str | None, query: str | None):
        self.empty = is_empty(text)
        self.silent = self.empty or is_copy(text, query)
        if self.silent:
            return
        self.text, self.query = text, query
        self.opening = opening(text, query)
        self.cued = _cued(text)
        self.first_cued = self.cued and _cued(_sentences(text.strip())[0])
        self.declines = self.cued and not answers_something(text, query)
        self.answered = answers_something(text, query, True)

    def own(self) -> set[str]:
        return _content(self.text) - _content(self.query or "")

    def borne_out(self, other: "_Answer") -> bool | None:
        """Whether what the text says beyond the question's words comes back in the record's other answer.

        None if that answer cannot tell: it is empty, gives back the question, declines, or opens with the same words. A
        text without a content word of its own ("Yes.") says nothing that could be missed there, and counts as borne out.
        """
        if other.silent or other.declines or other.opening == self.opening:
            return None
        own = self.own()
        return not own or bool(own & other.own())


#: One row for each answer of each record: ``template`` is the question's own opening, ``cue`` a refusal's word in the first
#: sentence, ``answered`` whether more than the opening is said; an answer ``declines`` if any sentence has such a word,
#: none says more, and the other answer does not bear it out. The last three say whether the other answer can tell,
#: whether it bears the opening out, and whether the answer is in another language without a refusal's word.
CHECKED = T.StructType(
    [T.StructField("record_id", T.LongType()), T.StructField("answer_field", T.StringType()), T.StructField("defect", T.StringType()), T.StructField("opening", T.StringType()), T.StructField("template", T.StringType()), T.StructField("prompt", T.LongType())]
    + [T.StructField(c, T.BooleanType()) for c in ("cue", "answered", "declines", "known", "borne_out", "foreign")]
)


def _check(mine: _Answer, other: _Answer) -> tuple:
    """defect, opening and the flags of :data:`CHECKED` of one answer."""
    if mine.silent:
        return "empty" if mine.empty else "copied_question", None, *[False] * 6
    told = None if mine.answered and not mine.declines else mine.borne_out(other)  # asked only of answers that may be refusals
    defect = "wrong_language" if other_language(mine.text, mine.query) else "truncated" if breaks_off(mine.text) else None
    foreign = defect == "wrong_language" and not mine.first_cued
    return defect, mine.opening, mine.first_cued, mine.answered, mine.declines and not told, told is not None, bool(told), foreign


def direct_checks(records: DataFrame) -> DataFrame:
    """The rows of :data:`CHECKED`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        schema = to_arrow_schema(CHECKED)
        for batch in batches:
            rows = []
            for record, query, *answers in zip(*(c.to_pylist() for c in batch.columns)):
                prompt, template = xxhash.xxh3_64_intdigest(_same(query or "")) - (1 << 63), _template(query or "")
                said = [_Answer(text, query) for text in answers]
                for field, mine, other in zip(FIELDS, said, said[::-1]):
                    defect, start, *flags = _check(mine, other)
                    rows.append((record, field, defect, start, template, prompt, *flags))
            columns = list(zip(*rows)) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return records.select("record_id", "query", *FIELDS).mapInArrow(run, CHECKED)


def opening_templates(checked: DataFrame) -> DataFrame:
    """opening_key, class_key, answers, prompts, templates, cues, answered, known, borne_out, refusal: each distinct opening.

    The counts are those of the whole class of openings. Recurrence under unrelated questions reveals a refusal: a class
    that stands under at least ``MIN_PROMPTS`` different templates of questions, most of whose answers say no more than the
    opening, that is not what answers in a foreign language look like, and that the other answer of the record bears out
    less than once in ``RARELY`` times. A sound answer that recurs ("Because of ...", a name, "Yes.") is borne out. A class
    with a refusal's words in most of its answers needs different questions only. Questions are grouped into templates by
    the same classes.
    """
    opened = checked.where(F.length("opening") > 0).withColumns({"opening_key": F.xxhash64("opening"), "template_key": F.xxhash64("template")})
    flags = ("cue", "answered", "known", "borne_out", "foreign")
    by_prompt = opened.groupBy("opening_key", "opening", "template_key", "template", "prompt").agg(F.count(F.lit(1)).alias("answers"), *(F.count_if(c).alias(c) for c in flags))
    by_prompt = checkpoint(by_prompt)
    starts = by_prompt.select("opening_key", "opening").unionByName(by_prompt.select(F.col("template_key").alias("opening_key"), F.col("template").alias("opening")))
    classes = checkpoint(text_classes(starts.where(F.length("opening") > 0).distinct(), "opening_key", "opening"))
    kinds = classes.select(F.col("opening_key").alias("template_key"), F.col("class_key").alias("kind"))
    rarely = RARELY * F.col("borne_out") < F.col("known")
    revealed = (F.col("templates") >= MIN_PROMPTS) & rarely & (2 * F.col("foreign") < F.col("answers"))
    seeded = (F.col("prompts") >= MIN_PROMPTS) & (2 * F.col("cue") >= F.col("answers"))
    counted = (
        by_prompt.join(classes, "opening_key")
        .join(kinds, "template_key", "left")
        .groupBy("class_key")
        .agg(F.sum("answers").alias("answers"), F.count_distinct("prompt").alias("prompts"), F.count_distinct("kind").alias("templates"), *(F.sum(c).alias(c) for c in flags))
        .withColumn("refusal", (revealed | seeded) & (2 * F.col("answered") < F.col("answers")))
    )
    answers = by_prompt.select("opening_key").distinct()
    found = classes.join(answers, "opening_key", "left_semi").join(counted, "class_key")
    return found.select("opening_key", "class_key", "answers", "prompts", "templates", F.col("cue").alias("cues"), "answered", "known", "borne_out", "refusal")


def broken_pairs(records: DataFrame) -> DataFrame:
    """record_id, answer_field, defect: every defective answer with one defect type.

    Input needs record_id, query, actual_output and expected_output. Null and blank answers are empty; a null query can
    be neither copied nor missed in language; of several defects the first of empty, copied_question, refusal,
    wrong_language, truncated is named, but an answer in another language without a refusal's word is a refusal only as one
    of a class revealed by its recurrence. Records appended twice give a row each. An empty table gives an empty result.
    """
    checked = checkpoint(direct_checks(records))
    templates = opening_templates(checked)
    refusing = templates.where("refusal").select("opening_key", F.lit(True).alias("refusal"))
    joined = checked.withColumn("opening_key", F.xxhash64("opening")).join(refusing, "opening_key", "left")
    # Refusals of a known class, and single ones, whatever the size of their class.
    refused = (F.col("refusal").isNotNull() & ~F.col("answered")) | F.col("declines")
    defect = F.when(F.col("defect").isin("empty", "copied_question"), F.col("defect")).when(refused, F.lit("refusal")).otherwise(F.col("defect"))
    return joined.select("record_id", "answer_field", defect.alias("defect")).where(F.col("defect").isNotNull())

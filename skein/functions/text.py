"""Text expressions. All are built-in column functions; null in gives null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"[ \t\n\r\f]+"

# The named entities that plain text needs, decoded last to first so that &amp;lt; gives &lt;.
ENTITIES = (("&nbsp;", " "), ("&#39;", "'"), ("&quot;", '"'), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&"))


def plain_text(markup: Column) -> Column:
    """Text of HTML or Markdown: scripts, styles and comments dropped, marks removed, parts joined by one blank."""
    out = F.regexp_replace(markup, r"(?is)<script[^>]*>.*?</script>", " ")
    out = F.regexp_replace(out, r"(?is)<style[^>]*>.*?</style>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"!\[[^\]]*\]\([^)]*\)", " ")
    out = F.regexp_replace(out, r"\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"(?m)^[ \t]*(?:#{1,6}|[-*+]|>)[ \t]+", "")
    out = F.regexp_replace(out, r"\*\*|__|`", "")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for name, sign in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(out, BLANKS, " "))


def is_blank(text: Column) -> Column:
    """True for null and for texts of white space only."""
    return F.coalesce(F.length(F.regexp_replace(text, BLANKS, "")) == 0, F.lit(True))


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.size(words(text)), F.lit(0))


def terms(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-case text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def sentences(text: Column) -> Column:
    """Sentences: cut at the white space after a full stop or question mark.

    Not after an abbreviation of two letters with points (``e.g.``) nor after a capital, a small letter and a point
    (``Dr.``), as the look-behinds say.
    """
    return F.split(text, r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?)\s")


def normal_name(name: Column) -> Column:
    """Trimmed, lower case, without one leading article; ``""`` for null."""
    return F.coalesce(F.regexp_replace(F.lower(F.trim(name)), r"^(the|a|an|la|el|los|las)[ \t\n\r\f]+", ""), F.lit(""))


def whole_words(text: Column, limit: int, from_end: bool = False) -> Column:
    """At most ``limit`` characters, cut at a blank: of the start, or of the end of the text."""
    if from_end:
        part = F.substring(text, -limit, limit)
        at = F.locate(" ", part)
        cut = F.when(at > 0, F.substr(part, at + 1)).otherwise(part)
    else:
        part = F.substring(text, 1, limit)
        cut = F.when(F.locate(" ", part) > 0, F.regexp_replace(part, r"(?s) [^ ]*$", "")).otherwise(part)
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def stable_id(text: Column) -> Column:
    """Hexadecimal SHA-256 of the text."""
    return F.sha2(text, 256)


def label_name(kind: Column) -> Column:
    """Upper camel case without quotes and blanks, for a graph label."""
    return F.replace(F.initcap(F.replace(F.replace(kind, F.lit('"'), F.lit("")), F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))


def fenced_json(answer: Column) -> Column:
    """The body of the first fenced json block; null if there is none, so that a missing fence is a failure."""
    found = F.regexp_extract(answer, r"(?s)```json\s*(.*?)\s*```", 1)
    return F.when(found != "", found)


def around(text: Column, term: Column, width: int = 100) -> Column:
    """The term with ``width`` characters on both sides, cut to whole words; null if the term does not occur."""
    at = F.locate(term, text) if isinstance(term, str) else F.instr(text, term)
    left = F.substr(text, F.greatest(at - width, F.lit(1)), at - F.greatest(at - width, F.lit(1)))
    right = F.substr(text, at + F.length(term), F.lit(width))
    return F.when(at > 0, F.concat(F.regexp_replace(left, r"^[^ ]* ", ""), term, F.regexp_replace(right, r" [^ ]*$", "")))

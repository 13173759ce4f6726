"""Expressions, on hand-checked cases and properties."""

import difflib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import fuzzy
from skein.functions import text as T
from skein.functions import vectors as V


def one(spark, expression, **columns):
    frame = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'array<double>'}" for k, v in columns.items()))
    return frame.select(expression.alias("x")).first()["x"]


def test_cosine(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, V.cosine(a, b), a=[1.0, 0.0], b=[0.0, 1.0]) == 0 and one(spark, V.cosine01(a, b), a=[1.0, 0.0], b=[0.0, 1.0]) == 0.5
    assert one(spark, V.cosine(a, b), a=[1.0, 0.0], b=[-1.0, 0.0]) == -1 and one(spark, V.cosine01(a, b), a=[1.0, 0.0], b=[-1.0, 0.0]) == 0
    assert one(spark, V.cosine(a, b), a=[0.0, 0.0], b=[1.0, 0.0]) == 0


def test_names_and_words(spark):
    rows = spark.createDataFrame([(" The Moon ",), ("Los Angeles",), ("Andes",), (None,), ("",)], "n string")
    assert [r[0] for r in rows.select(T.normal_name(F.col("n"))).collect()] == ["moon", "angeles", "andes", "", ""]
    text = F.col("t")
    assert one(spark, T.whole_words(text, 10), t="alpha beta gamma") == "alpha"
    assert one(spark, T.whole_words(text, 10, True), t="alpha beta gamma") == "gamma"
    assert one(spark, T.whole_words(text, 3), t="alphabet") == "alp" and one(spark, T.whole_words(text, 30), t="a b") == "a b"
    assert one(spark, T.word_count(text), t=None) == 0 and one(spark, T.word_count(text), t=" a  b\n") == 2


def test_sentences_json_and_markup(spark):
    text = F.col("t")
    assert one(spark, T.sentences(text), t="One. Two? Dr. No e.g. this. End") == ["One.", "Two?", "Dr. No e.g. this.", "End"]
    assert one(spark, T.fenced_json(text), t='x ```json\n{"a": 1}\n``` y') == '{"a": 1}' and one(spark, T.fenced_json(text), t="no fence") is None
    assert one(spark, T.plain_text(text), t="<p>A &amp;lt; <b>b</b></p><script>x()</script>\n# Head\n[l](u) ![i](u)") == "A &lt; b Head l"
    assert one(spark, T.label_name(text), t='"planetary body"') == "PlanetaryBody"
    assert "Mars" in one(spark, T.around(text, F.lit("Mars"), 8), t="we saw the red Mars rising slowly there")


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc ", max_size=12), st.text(alphabet="abc ", max_size=12))
def test_ratios(a, b):
    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            last = 0
            for j, d in enumerate(y):
                last, row[j + 1] = row[j + 1], last + 1 if c == d else max(row[j], row[j + 1])
        return row[-1]

    if a and b:
        assert fuzzy.indel_ratio(a, b) == pytest.approx(200 * lcs(a, b) / (len(a) + len(b)))
    assert 0 <= fuzzy.weighted_ratio(a, b) <= 100 and fuzzy.indel_ratio(a, b) == pytest.approx(fuzzy.indel_ratio(b, a))


def test_sequence_ratio(spark):
    assert one(spark, fuzzy.sequence_ratio(F.col("a"), F.col("b")), a="Ceres", b="Cerez") == difflib.SequenceMatcher(None, "Ceres", "Cerez").ratio()

"""Problems 1, 2, 4 and 5: pages."""

import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.llm import blocks, repeated_lines, residue, splitting
from skein.llm.train_blocks import weak_labels

PAGES = "page_id bigint, chunk string, url string, line_no int, lines string, site_key string"


def pages(spark, rows):
    return spark.createDataFrame([(i, c, u, 7, "x", "y") for i, c, u in rows], PAGES)


def brute_repeated(rows, support):
    def site(u):
        host = u.lower().split("//")[-1].split("/")[0].split("?")[0].split(":")[0]
        return host.removeprefix("www.")

    urls = defaultdict(set)
    lines = []
    for i, c, u in rows:
        if c is None or u is None:
            continue
        for k, line in enumerate(c.split("\n")):
            if any(x.isalpha() for x in line):
                key = (site(u), " ".join(line.lower().split()))
                urls[key].add(u)
                lines.append((i, k, key))
    return sorted((i, k) for i, k, key in lines if len(urls[key]) >= support)


def test_repeated_lines_match_brute_force(spark):
    rng = random.Random(1)
    hosts = ["https://A.example", "http://www.a.example:80", "https://b.example"]
    texts = ["Share  this", "share this", "Cookies\tare used", "1 2 3", "", "Body {0}", "ÄRGER über"]
    rows = []
    for i in range(60):
        chunk = "\n".join(rng.choice(texts).format(i) for _ in range(rng.randint(1, 8)))
        rows.append((i, chunk, f"{rng.choice(hosts)}/p{rng.randint(0, 20)}"))
    rows += [(100, None, "https://a.example/x"), (101, "Share this", None), (102, "", "https://a.example/e"), (103, "Share this\r\nShare this", "https://a.example/r")]
    rows += rows[:5]
    found = repeated_lines.repeated_occurrences(pages(spark, rows), 4)
    assert sorted((r[0], r[1]) for r in found.collect()) == brute_repeated(rows, 4)
    assert found.dtypes == [("page_id", "bigint"), ("line_no", "int")]


def test_repeated_lines_are_removed_and_grow_to_sequences(spark):
    rows = [(i, f"Menu\nHome page\nText number {i}\nLegal notice", f"https://s.example/{i}") for i in range(9)] + [(50, None, None)]
    clean = {r[0]: r[1] for r in repeated_lines.remove_repeated(pages(spark, rows)).collect()}
    assert clean[3] == "Text number 3" and clean[50] is None
    lengths = [r["length"] for r in repeated_lines.frequent_sequences(pages(spark, rows)).collect()]
    assert sorted(lengths) == [1, 1, 1, 2]
    empty = pages(spark, rows).limit(0)
    assert repeated_lines.repeated_occurrences(empty).isEmpty() and repeated_lines.frequent_sequences(empty).isEmpty()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n\r!é漢", max_size=150), st.sampled_from([(10, 3), (20, 5), (7, 0), (30, 12), (5, 4)]))
def test_pieces_fit_overlap_and_give_back_the_text(text, sizes):
    limit, overlap = sizes
    found = splitting.pieces(text, limit, overlap)
    assert all(len(p) <= limit for p in found)
    back = found[0]
    for before, piece in zip(found, found[1:]):
        head = before[-overlap:] if overlap else ""
        assert piece.startswith(head)
        back += piece[len(head) :]
    assert back == text and (len(found) == 1) == (len(text) <= limit)


def test_cuts_prefer_strong_boundaries():
    paragraphs = "\n\n".join(("word " * 15).strip() + "." for _ in range(4))
    assert all(paragraphs[at - 2 : at] == "\n\n" for at in splitting.cuts(paragraphs, 100, 10))
    sentences = " ".join("Ten words stand in this one short sentence of mine." for _ in range(5))
    assert all(sentences[at - 2] == "." for at in splitting.cuts(sentences, 100, 10))
    assert splitting.cuts("x" * 25, 10, 2) == [8, 16, 24]
    with pytest.raises(ValueError):
        splitting.cuts("x", 5, 5)


def test_split_pages(spark):
    rows = [(1, "a" * 9000, "u"), (2, "short", None), (3, None, None), (4, "", None), (5, "a b " * 3000, "v")]
    got = splitting.split_pages(pages(spark, rows)).groupBy("page_id").agg(F.count("*").alias("n"), F.max(F.length("piece")).alias("m")).collect()
    assert {r[0]: r[1] for r in got} == {1: 3, 2: 1, 5: 4} and max(r[2] for r in got) <= 4000
    assert sorted(r[0] for r in splitting.oversized(pages(spark, rows)).collect()) == [1, 5]
    assert splitting.split_pages(pages(spark, rows).limit(0)).isEmpty()


BODY = "The crust of Velor 123 is 45 km thick, and its dust ring was seen in 2101 by two teams at once."


def test_residue(spark):
    u = "https://s.example/a/velor-123-{}"
    rows = [
        (1, f"# Velor 123\n{BODY}", u.format(1)),
        (2, "# Velor 123\n404 Not Found\nThe page you asked for is not on this server.", u.format(2)),
        (3, f"{BODY}\nObserved by {{{{ name }}}} near it.", u.format(3)),
        (4, "Lorem ipsum dolor sit amet consectetur", u.format(4)),
        (5, "Please enable JavaScript to view this page.", None),
        (6, f"{BODY}\nThe term error page is used here. In code, print(f\"{{x:.0f}}\") writes it; the set {{a, b, c}} cost $5.", u.format(6)),
        (7, None, u.format(7)), (8, "", u.format(8)), (9, " \n\t", u.format(9)), (10, "Velor 123 is small.", u.format(10)),
        (11, "test " * 30000, u.format(11)), (12, f"Access denied\nMore from this section\n{BODY.replace('Velor 123', 'Other 9')}", u.format(12)),
        (13, "word " * 60000, u.format(13)),
    ]
    got = {r[0]: r[1] for r in residue.residue_pages(pages(spark, rows)).collect()}
    assert {k: v for k, v in got.items() if k != 13} == {2: "error", 3: "slot", 4: "filler", 5: "scripts", 11: "filler", 12: "error"}
    kept = residue.keep_content(pages(spark, rows))
    assert 1 in {r[0] for r in kept.collect()} and kept.columns == pages(spark, rows).columns
    assert residue.residue_pages(pages(spark, rows).limit(0)).isEmpty()


def test_residue_of_messages_that_are_the_sites_boilerplate(spark):
    rows = [(i, f"Please enable cookies to comment\nNote {i}", f"https://s.example/{i}") for i in range(30)]
    assert residue.residue_pages(pages(spark, rows)).isEmpty()


PAGE = """Menu
Home | News | Archive

# Orbit of Velor 123
By Ann Smith, staff writer at Star Log
The crust of Velor 123 is 45 km thick near the south pole, more than at Other 9.

Velor 123 completes one orbit in 70.04 h, and its rotation takes 38.1 a. Two burns moved the craft to 12 AU from Velor 123.

Related stories
Orbit of Other 9
Two burns moved the craft to 44 km from Other 9.

© 2130 Star Log. All rights reserved."""


def test_blocks_of_a_page_no_site_of_which_was_trained_on(spark):
    rows = [(1, PAGE, "https://star-log.example/a/velor-123-1"), (2, None, "u"), (3, " \n", "u"), (4, PAGE.replace("\n", "\r\n"), "https://star-log.example/a/velor-123-4")]
    found = defaultdict(set)
    for r in blocks.boilerplate_lines(pages(spark, rows)).collect():
        found[r[0]].add(r[1])
    assert found[1] == found[4] == {0, 1, 4, 9, 10, 11, 13} and set(found) == {1, 4}
    body = {r[0]: r[1] for r in blocks.main_bodies(pages(spark, rows)).collect()}
    assert body[1].startswith("# Orbit of Velor 123\nThe crust") and body[2] is None and body[3] == ""
    assert blocks.block_labels(pages(spark, rows).limit(0)).isEmpty()


def test_network_agrees_with_a_plain_loop():
    import numpy as np

    network, reader = blocks.Network.load(), blocks.Reader()
    places, tags, words, figures = reader.page(PAGE, "https://star-log.example/a/velor-123-1")
    starts = np.cumsum([0] + [len(w) for w in words[:-1]])
    x = network.inputs(np.array(tags), np.concatenate([np.array(w) for w in words]), starts, figures)
    w, h = network.w, blocks.HIDDEN
    sig = lambda z: 1 / (1 + np.exp(-z))
    states = []
    for name, order in (("f", range(len(x))), ("r", range(len(x) - 1, -1, -1))):
        s, c, out = np.zeros(h), np.zeros(h), {}
        for t in order:
            z = x[t] @ w[f"w{name}"] + s @ w[f"u{name}"] + w[f"b{name}"]
            c = sig(z[h : 2 * h]) * c + sig(z[:h]) * np.tanh(z[3 * h :])
            s = sig(z[2 * h : 3 * h]) * np.tanh(c)
            out[t] = s
        states.append(np.array([out[t] for t in range(len(x))]))
    want = np.concatenate([*states, x], axis=1) @ w["out"] + w["bias"]
    got = dict((i, m) for i, _, m in network.label(reader, ["a b", PAGE], [None, "https://star-log.example/a/velor-123-1"]))[1]
    assert np.allclose(got, want, atol=1e-3)


def test_weak_labels():
    marks = weak_labels(PAGE)
    assert [k for k, v in marks.items() if v] == [0, 1, 4, 9, 10, 11, 13]


def test_patterns_grow_over_gaps_to_the_longest(spark):
    rng = random.Random(3)
    rows = []
    for i in range(30):
        lines = [f"common {chr(97 + k)}" for k in range(20)]
        if i % 3 == 0:
            lines = lines[4:15]
        for k in sorted(rng.sample(range(len(lines)), 3), reverse=True):
            lines.insert(k, f"own line {i} {k}")
        rows.append((i, "\n".join(lines), f"https://s.example/{i}"))
    rows += [(40 + i, "common c\ncommon a", f"https://other.example/{i}") for i in range(4)]
    sequences = {i: [x for x in c.split("\n") if x.startswith("common")] for i, c, _ in rows[:30]}

    def support(p):
        return sum(any(s[k : k + len(p)] == p for k in range(len(s))) for s in sequences.values())

    want = set()
    for s in sequences.values():
        reach = 0
        for k in range(len(s)):
            end = max(e for e in range(k + 1, len(s) + 1) if support(s[k:e]) >= 8)
            if end > reach:
                want.add((tuple(s[k:end]), support(s[k:end])))
            reach = end
    got = repeated_lines.frequent_patterns(pages(spark, rows)).collect()
    assert {(tuple(r["lines"]), r["n_urls"]) for r in got} == want and {r["site"] for r in got} == {"s.example"}
    assert max(r["length"] for r in got) == 20 and len(got) == len(want)
    assert repeated_lines.frequent_patterns(pages(spark, rows).limit(0)).isEmpty()

"""Pairs of names against the ratio of every pair, whatever they have in common."""

import random
from itertools import combinations

import numpy as np

from skein.functions import alike
from skein.functions.fuzzy import weighted_ratio
from skein.functions.linkage import linked_clusters
from skein.operators import resolution


def test_names_meet_by_a_token_of_any_number_of_names_and_by_parts(spark, monkeypatch):
    """210 names have a token in common; others are a part of a longer one, or differ in blanks or repeated tokens."""
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    names = {f"system {letters(rng.randint(2, 18))}" for _ in range(210)} | {"sunflower field", "sunflower", "low field", "ring\tsystem", "outer ring", "dust  dust", "dust", "dust cloud", "\t", "\n"}
    want = {(a, b): weighted_ratio(a, b) for a, b in combinations(sorted(names), 2)}
    want = {k: v for k, v in want.items() if v >= 85}
    assert ("sunflower", "sunflower field") in want and ("\t", "\n") in want and sum(a.startswith("system") and b.startswith("system") for a, b in want) > 5000
    monkeypatch.setattr(resolution, "BLOCK_NAMES", 90)
    found = resolution.weighted_names(spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert len(found) == len(want) and {(r["a"], r["b"]): r["score"] for r in found} == want


def test_linkage_of_large_components_is_that_of_all_pairs(spark, monkeypatch):
    """A component of more names than a table is made for is clustered whole; distances are turned a little, so that none are equal."""
    rng = random.Random(2)
    letters = "abcdefghijklmnop"
    names = set()
    for base in ["".join(rng.choice(letters) for _ in range(30)) for _ in range(2)]:
        for _ in range(110):
            word = list(base)
            for _ in range(rng.randint(0, 5)):
                word[(k := rng.randrange(len(word))) : k + 1] = [rng.choice(letters) for _ in range(rng.choice([0, 1, 2]))]
            names.add("".join(word))
    names = sorted(names)
    plain = alike.scores

    def turned(own, i, j):
        a, b = np.minimum(i, j), np.maximum(i, j)
        return plain(own, i, j) - 1e-4 * ((a * 7919 + b * 104729) % 10007 / 10007)

    monkeypatch.setattr(alike, "scores", turned)
    matrix = alike.score_matrix(names)
    x, y = np.nonzero(np.triu(matrix >= 85, 1))
    want = resolution.average_linkage(names)
    groups = lambda labels: {frozenset(n for n, k in zip(names, labels) if k == c) for c in set(labels)}
    found = groups(linked_clusters(names, x, y, matrix[x, y], 15).tolist())
    assert found == groups(want) and max(map(len, found)) > 20
    monkeypatch.setattr(alike, "scores", plain)
    monkeypatch.setattr(resolution, "TABLE_NAMES", 20)
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r["name"]: r["cluster"] for r in resolution.name_clusters(frame).collect()}
    distance = 100 - alike.score_matrix(names)
    labels = np.array([names.index(got.get(n, n)) for n in names])
    member = (labels[:, None] == np.unique(labels)) / np.bincount(labels, minlength=len(names))[np.unique(labels)]
    between = member.T @ distance @ member
    np.fill_diagonal(between, 100)
    assert between.min() >= 15 - 1e-9 and max(np.unique(labels, return_counts=True)[1]) > 20


def test_a_component_of_any_size_is_not_cut(spark):
    """1,600 names that are one cluster: once at most 1,000 were taken together."""
    names = [f"the observatory of saturn and its rings and moons {k}" for k in range(1600)]
    found = resolution.name_clusters(spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert len(found) == 1600 and len({r["cluster"] for r in found}) == 1

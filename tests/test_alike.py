"""Ratios and candidates of names by arrays, against the ratio of each pair."""

import random

import numpy as np

from skein.functions import alike
from skein.functions.fuzzy import weighted_ratio
from skein.operators import resolution

WORDS = ["kuiper", "belt", "kuipr", "sun", "sunn", "new", "horizons", "probe", "28", "2805", "28015", "rings", "satrn", "a", "süd", "x" * 30, "y" * 39]


def test_ratios_of_arrays_are_those_of_each_pair():
    rng = random.Random(3)
    names = sorted({" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4))) for _ in range(90)} | {"a  b", "kuiper\tbelt", "a\0b", "ab\0"}, key=len)
    want = np.array([[weighted_ratio(a, b) if a != b else 0.0 for b in names] for a in names])
    assert (alike.score_matrix(names) == np.maximum(want, want.T)).all()
    near = np.array([[2 * max(len(a), len(b)) < 3 * min(len(a), len(b)) for b in names] for a in names])
    shared = np.array([[not set(a.split()).isdisjoint(b.split()) for b in names] for a in names])
    own = alike.Names(names)
    i, j = np.triu_indices(len(names), 1)
    assert alike.promising(own, own, i, j, 85, shared[i, j])[(want[i, j] >= 85) & (near | shared)[i, j]].all()
    found = {x for p, q in alike.tiled(own, None, 85, 25) for x in zip(p.tolist(), q.tolist())}
    assert {x for x in zip(i.tolist(), j.tolist()) if want[x] >= 85 and near[x] and not shared[x]} <= found
    assert found == {(min(x), max(x)) for p, q in alike.tiled(own, own, 85, 25) for x in zip(p.tolist(), q.tolist()) if x[0] != x[1]}


def test_names_of_a_high_ratio_meet_whatever_their_edits(spark, monkeypatch):
    """Four edits of fifteen characters; and cells of several blocks."""
    rng = random.Random(5)
    names = sorted({rng.choice(["sev", "tav"]) + rng.choice(["il", "or"]) + rng.choice(["tane", "dun"]) + f" {rng.randint(1, 3000)}" for _ in range(150)} | {"abcdefghijklmn", "xabdefghijlmny"})
    want = {(a, b, weighted_ratio(a, b)) for a in names for b in names if a < b and weighted_ratio(a, b) >= 85}
    assert ("abcdefghijklmn", "xabdefghijlmny") in {w[:2] for w in want}
    monkeypatch.setattr(resolution, "BLOCK_NAMES", 40)
    found = resolution.weighted_names(spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == want

"""Average linkage of many names by the pairs that are alike."""

from __future__ import annotations

import numpy as np

from skein.functions import alike


def linked_clusters(names: list[str], x: np.ndarray, y: np.ndarray, score: np.ndarray, cut: float) -> np.ndarray:
    """Labels of the average-linkage clusters under 100 - weighted ratio, merged while the least mean is below ``cut``.

    ``x``, ``y`` and ``score`` are all pairs of names that are nearer than ``cut``. Clusters without such a pair between
    them have a mean of ``cut`` or more, so means are kept only of those with one, and each is that of all pairs: what is
    not known of them is scored when their clusters are merged, every pair once at most. All pairs of clusters that are
    nearest to each other are merged at once, which average linkage allows: a merged cluster is no nearer to another than
    the nearer of its parts. Equal means are taken in the order of a hash.
    """
    n, own = len(names), alike.Names(names)
    x, y = np.minimum(x, y).astype(np.int64), np.maximum(x, y).astype(np.int64)
    mean, weight = 100.0 - score, np.ones(len(x))
    label, size = np.arange(n), np.ones(n)
    while True:
        merged = _nearest(x, y, mean, cut, n)
        if not len(merged):
            return label
        into, before = np.arange(n), label
        into[y[merged]] = x[merged]
        label = into[before]
        old_size, size = size, np.bincount(label, minlength=n).astype(float)
        changed = np.zeros(n, bool)
        changed[x[merged]] = changed[y[merged]] = True
        second = np.full(n, -1)
        second[x[merged]] = y[merged]
        touched = changed[x] | changed[y]
        touched[merged] = False
        kept = ~touched
        kept[merged] = False
        a, b, total, known = x[touched], y[touched], mean[touched] * weight[touched], weight[touched]
        held = np.sort(a * n + b)
        p, q = into[a], into[b]
        keys, at = np.unique(np.minimum(p, q) * n + np.maximum(p, q), return_inverse=True)
        total, known = np.bincount(at, total, len(keys)), np.bincount(at, known, len(keys))
        p, q = keys // n, keys % n
        # Parts of merged clusters between which nothing is known yet.
        short = np.flatnonzero(known < size[p] * size[q])
        left, right = (np.stack([c[short], second[c[short]]]) for c in (p, q))
        left, right, row = np.repeat(left, 2, 0).ravel(), np.tile(right, (2, 1)).ravel(), np.tile(short, 4)
        there = (left >= 0) & (right >= 0)
        left, right, row = left[there], right[there], row[there]
        key = np.minimum(left, right) * n + np.maximum(left, right)
        new = held[np.minimum(np.searchsorted(held, key), len(held) - 1)] != key if len(held) else np.zeros(0, bool)
        left, right, row = left[new], right[new], row[new]
        total += np.bincount(row, _sums(own, before, old_size, left, right, n), len(keys))
        known += np.bincount(row, old_size[left] * old_size[right], len(keys))
        x, y = np.r_[x[kept], p], np.r_[y[kept], q]
        mean, weight = np.r_[mean[kept], total / known], np.r_[weight[kept], known]


def _nearest(x: np.ndarray, y: np.ndarray, mean: np.ndarray, cut: float, n: int) -> np.ndarray:
    """The rows whose clusters are nearest to each other, of those below ``cut``."""
    rows = np.flatnonzero(mean < cut)
    mixed = (x[rows] * n + y[rows]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rows = rows[np.lexsort((mixed ^ (mixed >> np.uint64(31)), mean[rows]))]
    best = np.full(n, -1)
    best[np.stack([x[rows], y[rows]], 1).ravel()[::-1]] = np.repeat(rows[::-1], 2)
    return rows[(best[x[rows]] == rows) & (best[y[rows]] == rows)]


def _sums(own: alike.Names, label: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The sum of 100 - weighted ratio of all pairs of a member of each of ``left`` and one of ``right``, which are labels."""
    out, order = np.zeros(len(left)), np.argsort(label, kind="stable")
    first, size = np.searchsorted(label[order], np.arange(n)), size.astype(np.int64)
    pairs = size[left] * size[right]
    ends = np.cumsum(pairs)
    for start in range(0, int(ends[-1]) if len(ends) else 0, alike.PAIRS):
        k = np.arange(start, min(start + alike.PAIRS, int(ends[-1])))
        row = np.searchsorted(ends, k, "right")
        place = k - (ends[row] - pairs[row])
        i = order[first[left[row]] + place // size[right[row]]]
        j = order[first[right[row]] + place % size[right[row]]]
        out += np.bincount(row, 100.0 - alike.scores(own, i, j), len(left))
    return out

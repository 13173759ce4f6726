"""Steps between the nodes of one graph, many sources at once."""

from __future__ import annotations

import numpy as np

#: Neighbours of a node that are taken in step with those of other nodes; the rest of a hub is reduced alone, so many at a time.
ABREAST, HUB_ROWS = 32, 16_384
#: Bytes of a block's bits, and of the rows that are worked on at once.
STATE, CHUNK = 1 << 26, 1 << 23


def inward(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """ends, near from distinct links ``dst << 32 | src``, which are sorted in place: node v is entered from near[ends[v]:ends[v + 1]]."""
    keys.sort()
    ends = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount((keys >> 32).astype(np.int32), minlength=n), out=ends[1:])
    return ends, keys.astype(np.uint32).astype(np.int32)


def width(n: int, words: int) -> int:
    """Words for the sources of a block over ``n`` nodes, at most ``words``."""
    return max(1, min(words, STATE // (8 * max(1, n))))


def _entered(seen: np.ndarray, rows: np.ndarray, ends: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The bits of ``rows``, which have falling degrees, with those of the nodes that lead to them."""
    begin, degree = ends[rows], ends[rows + 1] - ends[rows]
    out = seen[rows]
    for j in range(min(ABREAST, int(degree[0]))):
        k = int(np.searchsorted(-degree, -j))
        out[:k] |= seen[near[begin[:k] + j]]
    for i in range(int(np.searchsorted(-degree, -ABREAST))):
        for a in range(int(begin[i]) + ABREAST, int(begin[i] + degree[i]), HUB_ROWS):
            out[i] |= np.bitwise_or.reduce(seen[near[a : min(a + HUB_ROWS, int(begin[i] + degree[i]))]], axis=0)
    return out


def block_profile(ends: np.ndarray, near: np.ndarray, first: int, last: int) -> list[tuple[int, int, int]]:
    """hop, pairs, ended of the sources ``first`` to ``last`` - 1: pairs that far apart, and sources with no node farther.

    A node holds one bit for each source that reaches it, a hop is a bitwise or over the links, and a node that all
    sources have reached is left out.
    """
    n, at = len(ends) - 1, np.arange(last - first)
    seen = np.zeros((n, -(-len(at) // 64)), np.uint64)
    seen[first + at, at // 64] = np.uint64(1) << (at % 64).astype(np.uint64)
    full = np.bitwise_or.reduce(seen, axis=0)
    degree = np.diff(ends)
    rows = np.argsort(-degree, kind="stable")
    rows = rows[: np.count_nonzero(degree)]
    step = max(1, CHUNK // (8 * seen.shape[1]))
    found, alive, pairs, hop = [], full, 0, 0
    while alive.any():
        rows = rows[(seen[rows] != full).any(axis=1)]
        going, met, changed = np.zeros_like(full), 0, []
        for a in range(0, len(rows), step):
            part = rows[a : a + step]
            now = _entered(seen, part, ends, near)
            fresh = now & ~seen[part]
            hit = fresh.any(axis=1)
            going |= np.bitwise_or.reduce(fresh, axis=0)
            met += int(np.bitwise_count(fresh).sum())
            changed.append((part[hit], now[hit]))
        for part, now in changed:  # only now, so that a hop is one step
            seen[part] = now
        found.append((hop, pairs, int(np.bitwise_count(alive & ~going).sum())))
        alive, pairs, hop = going, met, hop + 1
    return found

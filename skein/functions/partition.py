"""Partition of one weighted graph under the constant Potts model: local moving, refinement and aggregation, to the end."""

from __future__ import annotations

from collections import defaultdict, deque
from functools import lru_cache

import numpy as np

from skein.functions.parts import weak_parts

TINY = 1e-12
#: Edges beyond which :func:`potts_partition` works on arrays.
ARRAY_EDGES = 20_000
#: Nodes of which all partitions are tried.
EXACT_NODES = 9
Neighbours = list[dict[int, float]]


def quality(near: Neighbours, size: list[float], label: list[int], resolution: float) -> float:
    """Weight inside communities less the resolution times the pairs of unit nodes of different nodes inside."""
    inside = sum(w for v, own in enumerate(near) for u, w in own.items() if u > v and label[u] == label[v])
    total, squares = defaultdict(float), defaultdict(float)
    for v, c in enumerate(label):
        total[c] += size[v]
        squares[c] += size[v] ** 2
    return inside - resolution * sum((total[c] ** 2 - squares[c]) / 2 for c in total)


def _move(near: Neighbours, size: list[float], label: list[int], resolution: float, order: np.ndarray) -> bool:
    """Move nodes to the community of greatest gain until none gains; a node whose neighbour moved is looked at again."""
    n = len(near)
    total = np.bincount(label, size, n).tolist()
    members = np.bincount(label, minlength=n).tolist()
    free = [c for c in range(n) if not members[c]]
    queue, waiting, changed = deque(order.tolist()), [True] * n, False
    while queue:
        v = queue.popleft()
        waiting[v] = False
        old, pull = label[v], defaultdict(float)
        for u, w in near[v].items():
            pull[label[u]] += w
        total[old] -= size[v]
        best, gain = old, pull.get(old, 0.0) - resolution * size[v] * total[old]
        for c in sorted(pull):
            if c != old and (g := pull[c] - resolution * size[v] * total[c]) > gain + TINY:
                best, gain = c, g
        if gain < -TINY and members[old] > 1:
            best = free.pop()
        total[best] += size[v]
        if best != old:
            changed = True
            label[v] = best
            members[old] -= 1
            members[best] += 1
            if not members[old]:
                free.append(old)
            for u in near[v]:
                if label[u] != best and not waiting[u]:
                    waiting[u] = True
                    queue.append(u)
    return changed


def _refine(near: Neighbours, size: list[float], label: list[int], resolution: float, order: np.ndarray) -> list[int]:
    """Communities cut into well-connected ones: single nodes join, inside their community, where they gain most."""
    n = len(near)
    whole = np.bincount(label, size, n)
    fine, total, alone = list(range(n)), list(size), [True] * n
    # Weight from each refined community to the rest of its community.
    out = [sum(w for u, w in near[v].items() if label[u] == label[v]) for v in range(n)]
    linked = lambda c, at: out[c] + TINY >= resolution * total[c] * (whole[label[at]] - total[c])
    for v in order.tolist():
        if not alone[v] or not linked(v, v):
            continue
        pull: dict[int, float] = defaultdict(float)
        for u, w in near[v].items():
            if label[u] == label[v] and u != v:
                pull[fine[u]] += w
        best, gain = v, 0.0
        for c in sorted(pull):
            if c != v and linked(c, v) and (g := pull[c] - resolution * size[v] * total[c]) > gain + TINY:
                best, gain = c, g
        if best != v:
            out[best] += out[v] - 2 * pull[best]
            total[best] += size[v]
            fine[v], alone[best] = best, False
            # The community is named after a node that stays in it.
            alone[v] = False
    return fine


def _once(near: Neighbours, size: list[float], label: list[int], resolution: float, rng: np.random.Generator) -> list[int]:
    """One descent: move, refine, aggregate, and again on the aggregate."""
    home = list(range(len(near)))
    while True:
        _move(near, size, label, resolution, rng.permutation(len(near)))
        if len(set(label)) == len(near):
            break
        fine = _refine(near, size, label, resolution, rng.permutation(len(near)))
        names = {c: k for k, c in enumerate(dict.fromkeys(fine))}
        if len(names) == len(near):
            # Nothing is well connected enough to be joined; the communities themselves are aggregated.
            fine = label
            names = {c: k for k, c in enumerate(dict.fromkeys(fine))}
        fine = [names[c] for c in fine]
        merged: Neighbours = [defaultdict(float) for _ in names]
        for v, own in enumerate(near):
            for u, w in own.items():
                if fine[u] != fine[v]:
                    merged[fine[v]][fine[u]] += w
        sizes, outer = [0.0] * len(names), [0] * len(names)
        for v, k in enumerate(fine):
            sizes[k] += size[v]
            outer[k] = label[v]
        codes = {c: k for k, c in enumerate(dict.fromkeys(outer))}
        home = [fine[h] for h in home]
        near, size, label = merged, sizes, [codes[c] for c in outer]
    return [label[h] for h in home]


def potts_partition(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, size: np.ndarray, resolution: float, seed: int = 7, starts: int = 8, array_edges: int = ARRAY_EDGES) -> list[int]:
    """A label for each node 0..n-1, the best of ``starts`` seeded descents, each repeated until it gains nothing.

    The first descent starts from single nodes, the second from one community, the others by turns from random labels and
    from the best so far with a fifth of its nodes put to random neighbours. Edges may run both ways or be repeated; of a pair the greatest weight counts. Every community is connected.
    Of up to ``EXACT_NODES`` nodes all partitions are tried instead.
    With more than ``array_edges`` edges nodes move in blocks by arrays, and communities are not refined before they are folded.
    """
    n = len(size)
    if len(src) > array_edges:
        return _by_arrays(np.asarray(src, np.int64), np.asarray(dst, np.int64), np.asarray(weight, float), np.asarray(size, float), resolution, seed, starts)
    near: Neighbours = [{} for _ in range(n)]
    for a, b, w in zip(src.tolist(), dst.tolist(), weight.tolist()):
        if a != b:
            near[a][b] = near[b][a] = max(w, near[a].get(b, w))
    size, rng = [float(s) for s in size], np.random.default_rng(seed)
    if n <= EXACT_NODES:
        return _connected(near, _best(near, size, resolution))
    best, best_value = list(range(n)), -np.inf
    for start in range(starts):
        if start < 2 or start % 2 == 0:
            label = list(range(n)) if start == 0 else [0] * n if start == 1 else rng.integers(0, max(1, n // 3), n).tolist()
        else:
            label = list(best)
            for v in rng.permutation(n)[: max(1, n // 5)].tolist():
                if near[v]:
                    label[v] = label[list(near[v])[rng.integers(len(near[v]))]]
        value = -np.inf
        while True:
            label = _connected(near, _once(near, size, label, resolution, rng))
            now = quality(near, size, label, resolution)
            if now <= value + 1e-9:
                break
            value = now
        if value > best_value + 1e-9:
            best, best_value = label, value
    return best


@lru_cache
def _partitions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All partitions of n nodes: the label of each node, which is the first node of its community, and whether the nodes of each pair are together."""
    found = [(0,)]
    for v in range(1, n):
        found = [(*label, c) for label in found for c in (*sorted(set(label)), v)]
    label = np.array(found)
    a, b = np.triu_indices(n, 1)
    return label, (label[:, a] == label[:, b]).astype(float)


def _best(near: Neighbours, size: list[float], resolution: float) -> list[int]:
    """Labels of the best of all partitions, the last of equal ones, which has more communities."""
    n = len(near)
    if n < 2:
        return list(range(n))
    label, together = _partitions(n)
    value = together @ np.array([near[u].get(v, 0.0) - resolution * size[u] * size[v] for u in range(n) for v in range(u + 1, n)])
    return label[np.flatnonzero(value >= value.max() - 1e-9)[-1]].tolist()


def _connected(near: Neighbours, label: list[int]) -> list[int]:
    """Each community cut into its connected parts, which costs no weight and saves pairs."""
    out = [-1] * len(near)
    for v in range(len(near)):
        if out[v] < 0:
            out[v], stack = v, [v]
            while stack:
                at = stack.pop()
                for u in near[at]:
                    if out[u] < 0 and label[u] == label[at]:
                        out[u] = v
                        stack.append(u)
    return out


#: Edges that local moving by arrays looks at together, and the blocks at least that a pass over the nodes is cut into.
BLOCK_EDGES, BLOCKS = 1 << 20, 16


def _value(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, size: np.ndarray, label: np.ndarray, resolution: float) -> float:
    """:func:`quality` of edges that are there in both directions."""
    return weight @ (label[src] == label[dst]) / 2 - resolution * (np.bincount(label, size) ** 2 - np.bincount(label, size**2)).sum() / 2


def folded(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, size: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, ...]:
    """src, dst, weight and size of the graph whose nodes are the communities 0..k-1 of ``label``."""
    sizes = np.bincount(label, size)
    a, b = label[src], label[dst]
    cut = a != b
    key = a[cut].astype(np.int64) * len(sizes) + b[cut]
    del a, b
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else key
    key = key[first]
    return (key // len(sizes)).astype(np.int32), (key % len(sizes)).astype(np.int32), np.add.reduceat(weight[cut][order], first) if len(first) else weight[:0], sizes


def _offers(rows: np.ndarray, bounds: np.ndarray, dst: np.ndarray, weight: np.ndarray, size: np.ndarray, label: np.ndarray, total: np.ndarray, resolution: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of ``rows``, which have edges: its best community, what it is worth there, and where it is."""
    degree = bounds[rows + 1] - bounds[rows]
    row = np.repeat(np.arange(len(rows)), degree)
    at = np.arange(len(row)) + np.repeat(bounds[rows] - np.cumsum(degree) + degree, degree)
    key = row * len(size) + label[dst[at]]
    order = np.argsort(key, kind="stable")  # rows follow each other already, which a stable sort makes use of
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    row = row[first]
    to, pull = key[first] - row * len(size), np.add.reduceat(weight[at[order]], first)
    own, mass = label[rows], size[rows]
    here = to == own[row]
    value = pull - resolution * mass[row] * (total[to] - np.where(here, mass[row], 0.0))
    stay = -resolution * mass * (total[own] - mass)
    stay[row[here]] = value[here]
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    best = np.maximum.reduceat(value, start)
    top = np.flatnonzero(value >= best[row])
    chosen = top[np.r_[True, row[top][1:] != row[top][:-1]]]  # the least community of equal ones
    return to[chosen], best, stay


def moved(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, size: np.ndarray, resolution: float, seed: int = 7, start: np.ndarray | None = None, patience: int = 4) -> np.ndarray:
    """A label for each node: connected communities after local moving by arrays, from single nodes or the labels ``start``.

    ``src``, ``dst`` and ``weight`` have each edge once in both directions, in the order of ``src``. Nodes move in random blocks, of those that
    gain a random half; a node is looked at again if it did not move or a neighbour did, until nothing gains or
    ``patience`` passes bring nothing better.
    """
    n, rng = len(size), np.random.default_rng(seed)
    bounds = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(src, minlength=n), out=bounds[1:])
    label = (np.arange(n) if start is None else start).astype(np.int32)
    total, members, active = np.bincount(label, size, n), np.bincount(label, minlength=n), np.diff(bounds) > 0
    best, best_value, stale = label.copy(), _value(src, dst, weight, size, label, resolution), 0
    while stale < patience and active.any():
        nodes = rng.permutation(np.flatnonzero(active))
        held = np.cumsum(bounds[nodes + 1] - bounds[nodes])
        limit = min(BLOCK_EDGES, -(-int(held[-1]) // BLOCKS))
        for block in np.split(nodes, np.flatnonzero(np.diff(held // max(1, limit))) + 1):
            rows = np.sort(block)
            to, worth, stay = _offers(rows, bounds, dst, weight, size, label, total, resolution)
            alone = (worth < -TINY) & (members[label[rows]] > 1)
            gains = alone | (worth > stay + TINY)
            active[rows] = gains
            go = gains & (rng.random(len(rows)) < 0.5)
            free = np.flatnonzero(members == 0) if (alone & go).any() else members[:0]
            left = np.flatnonzero(alone & go)
            go[left[len(free) :]] = False
            to[left[: len(free)]] = free[: len(left)]
            who, to = rows[go], to[go]
            for ends, sign in ((label[who], -1), (to, 1)):
                np.add.at(total, ends, sign * size[who])
                np.add.at(members, ends, sign)
            label[who] = to
            degree = bounds[who + 1] - bounds[who]
            around = dst[np.arange(degree.sum()) + np.repeat(bounds[who] - np.cumsum(degree) + degree, degree)]
            active[around[label[around] != np.repeat(to, degree)]] = True
            active[who] = False
        value = _value(src, dst, weight, size, label, resolution)
        if value > best_value + 1e-9:
            best, best_value, stale = label.copy(), value, 0
        else:
            stale += 1
    inside = best[src] == best[dst]
    return weak_parts(src[inside], dst[inside], n)


def descent(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, size: np.ndarray, resolution: float, seed: int = 7, start: np.ndarray | None = None) -> np.ndarray:
    """Labels 0..k-1 by arrays: nodes move, communities move as nodes, and so on, and all again from what was found until nothing is gained."""
    order = np.argsort(src)
    src, dst, weight = src[order].astype(np.int32), dst[order].astype(np.int32), weight[order]
    best, best_value = np.arange(len(size)), -np.inf
    while True:
        graph, home, inner = (src, dst, weight, size), np.arange(len(size)), start
        while True:
            label = np.unique(moved(*graph, resolution, seed, inner), return_inverse=True)[1].astype(np.int32)
            home, inner, seed = label[home], None, seed + 1
            if label.max(initial=-1) + 1 == len(label):
                break
            graph = folded(*graph, label)
        now = _value(src, dst, weight, size, home, resolution)
        if now > best_value:
            best, gained, best_value = home, now - best_value, now
        else:
            gained = 0.0
        if gained <= 1e-9 + 1e-6 * abs(now):
            return best
        start = best


def _by_arrays(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, size: np.ndarray, resolution: float, seed: int, starts: int) -> list[int]:
    """:func:`potts_partition` with its starts, for a graph of many edges."""
    n, rng = len(size), np.random.default_rng(seed)
    loop = src == dst
    key = np.r_[src[~loop] * n + dst[~loop], dst[~loop] * n + src[~loop]]
    order = np.argsort(key)
    key, first = np.unique(key[order], return_index=True)
    graph = key // n, key % n, np.maximum.reduceat(np.r_[weight[~loop], weight[~loop]][order], first) if len(first) else weight[:0], size
    bounds = np.searchsorted(graph[0], np.arange(n + 1))
    best, best_value = np.arange(n), -np.inf
    for turn in range(starts):
        if turn < 2 or turn % 2 == 0:
            label = None if turn == 0 else np.zeros(n, np.int64) if turn == 1 else rng.integers(0, max(1, n // 3), n)
        else:
            label, some = best.copy(), rng.permutation(n)[: max(1, n // 5)]
            some = some[bounds[some + 1] > bounds[some]]
            label[some] = best[graph[1][rng.integers(bounds[some], bounds[some + 1])]]
        label = descent(*graph, resolution, seed + 100 * turn, label)
        value = _value(*graph, label, resolution)
        if value > best_value + 1e-9:
            best, best_value = label, value
    return best.tolist()

"""Components of one graph that a task holds: strong ones in linear time without recursion (Tarjan, 1972), weak ones by arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Distinct edges that one task holds, which takes about 50 bytes each.
TASK_EDGES = 10_000_000


def strong_parts(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """For each node 0..n-1 the greatest node of its strong component; an edge leads from ``src`` to ``dst``."""
    near = memoryview(dst[np.argsort(src)].astype(np.int32))
    bounds = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(src, minlength=n), out=bounds[1:])
    end, at = memoryview(bounds)[1:], memoryview(bounds[:-1].copy())  # at: the next edge of each node
    label = np.full(n, -1, np.int32)
    part, met, low = memoryview(label), memoryview(np.zeros(n, np.int32)), memoryview(np.zeros(n, np.int32))
    count, path, open_nodes = 0, [], []
    for root in range(n):
        if met[root]:
            continue
        path.append(root)
        while path:
            v = path[-1]
            if not met[v]:
                count += 1
                met[v] = low[v] = count
                open_nodes.append(v)
            k, stop, least = at[v], end[v], low[v]
            while k < stop:
                u = near[k]
                if not met[u]:
                    path.append(u)  # the edge is looked at again when u is done
                    break
                if part[u] < 0 and low[u] < least:
                    least = low[u]
                k += 1
            at[v], low[v] = k, least
            if k < stop:
                continue
            path.pop()
            if least == met[v]:
                start = len(open_nodes) - 1
                while open_nodes[start] != v:
                    start -= 1
                own = open_nodes[start:]
                del open_nodes[start:]
                top = max(own)
                for u in own:
                    part[u] = top
    return label


def weak_parts(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """For each node 0..n-1 the least node of its weak component."""
    label = np.arange(n, dtype=np.int32)
    while len(src):
        a, b = label[src], label[dst]
        split = a != b
        src, dst, a, b = src[split], dst[split], a[split], b[split]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))  # the greater root hangs on the least that it meets
        while (label[label] != label).any():
            label = label[label]
    return label


def labelled(parts: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over all edges (two columns of bigint) in one partition: node, component."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [tuple(column.to_numpy() for column in batch.columns) for batch in batches]
        if not ends:
            return
        src, dst = (np.concatenate([e[k] for e in ends]) for k in range(2))
        ends.clear()
        names = np.union1d(np.unique(src), np.unique(dst))
        found = parts(*(np.searchsorted(names, x).astype(np.int32) for x in (src, dst)), len(names))
        for a in range(0, len(names), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(names[a : a + 100_000]), pa.array(names[found[a : a + 100_000]])], ["node", "component"])

    return label

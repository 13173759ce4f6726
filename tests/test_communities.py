"""Parts of many edges: by arrays in a task, and by joins, against descents node by node."""

import random

import numpy as np

from skein.functions import partition
from skein.operators import communities


def test_arrays_reach_what_single_moves_reach():
    """600 nodes in groups of ten, some edges across; repeated, one-way and loop edges, and a node without any."""
    rng = random.Random(6)
    pairs = [(a, rng.randrange(a // 10 * 10, a // 10 * 10 + 10) if rng.random() < 0.8 else rng.randrange(600), round(rng.uniform(0.1, 1), 2)) for a in range(600) for _ in range(5)]
    near = [{} for _ in range(601)]
    for a, b, w in pairs:
        if a != b:
            near[a][b] = near[b][a] = max(w, near[a].get(b, w))
    for resolution in (1e-5, 0.036, 0.6):
        one, all_at_once = (partition.potts_partition(*(np.array([p[k] for p in pairs]) for k in range(3)), np.ones(601), resolution, array_edges=n) for n in (10**6, 0))
        values = [partition.quality(near, [1.0] * 601, x, resolution) for x in (one, all_at_once)]
        assert values[1] >= 0.97 * values[0]
        assert len(set(partition._connected(near, all_at_once))) == len(set(all_at_once))


def test_parts_too_large_for_starts_or_for_a_task(spark):
    rng = random.Random(4)
    pairs = {(a + 8 * k, b + 8 * k) for k in range(12) for a in range(8) for b in range(a) if rng.random() < 0.8} | {(8 * k, 8 * k + 8) for k in range(11)}
    far = 1 << 60  # numbers that a double does not hold
    edges = spark.createDataFrame([(far + x, far + y, 1.0) for a, b in pairs for x, y in ((a, b), (b, a))], "src bigint, dst bigint, weight double")
    nodes = spark.range(far, far + 100).selectExpr("id AS node", "0 AS parent")
    values = []
    for most in ({}, {"task_edges": 60}, {"task_edges": 60, "once_edges": 60}):
        spark.sparkContext.setJobGroup("parts", "")
        found = communities.potts_communities(edges, nodes, 0.3, **most)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("parts"))
        spark.sparkContext.setJobGroup(f"ended {most}", "")
        assert found.count() == found.select("node").distinct().count() == 100
        values.append((communities.objective(edges, found, 0.3), jobs))
        spark.sparkContext.setJobGroup("", "")
    assert min(values)[0] >= 0.97 * values[0][0]
    assert values[1][1] - values[0][1] < 40  # no rounds of joins for a part that a task holds


def test_small_parts_reach_the_best_of_all_partitions():
    """Graphs of nine nodes, of which eight descents missed the best of some."""
    label = [(0,)]
    for v in range(1, 9):
        label = [(*own, c) for own in label for c in (*sorted(set(own)), v)]
    for seed in (83, 106, 119):
        rng = random.Random(seed)
        pairs = {(a, b): round(rng.uniform(0.5, 1), 2) for a in range(9) for b in range(a) if rng.random() < 0.35}
        near = [{} for _ in range(9)]
        for (a, b), w in pairs.items():
            near[a][b] = near[b][a] = w
        found = partition.potts_partition(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]), np.array(list(pairs.values())), np.ones(9), 0.6)
        best = max(sum(pairs.get((u, v), 0.0) - 0.6 for u in range(9) for v in range(u) if own[u] == own[v]) for own in label)
        assert abs(partition.quality(near, [1.0] * 9, found, 0.6) - best) < 1e-9
        assert len(set(partition._connected(near, found))) == len(set(found))

"""Distances of all nodes against brute force."""

import random
from collections import Counter

import pytest

from skein.operators import traversal
from skein.operators.components import connected_components


def test_profile_of_all_nodes(spark):
    rng = random.Random(5)
    pairs = {(rng.randint(0, 79), rng.randint(0, 79)) for _ in range(160)} | {(i, (i + 1) % 80) for i in range(80)}
    want, ended = Counter(), Counter()
    for source in range(80):
        hops, frontier = {source: 0}, {source}
        while frontier:
            frontier = {b for a, b in pairs if a in frontier} - set(hops)
            hops |= dict.fromkeys(frontier, max(hops.values()) + 1)
        want.update(h for h in hops.values() if h)
        ended[max(hops.values())] += 1
    edges = spark.createDataFrame(sorted(pairs), "src bigint, dst bigint")
    rows = traversal.distance_profile(edges, spark.range(80).withColumnRenamed("id", "node"), words=1).collect()
    assert {r["hop"]: r["pairs"] for r in rows if r["pairs"]} == want and {r["hop"]: r["ended"] for r in rows if r["ended"]} == ended
    with pytest.raises(RuntimeError):
        traversal.distances(edges, spark.createDataFrame([(0,)], "node bigint"), 1)


def test_tasks_walk_what_joins_walk(spark):
    """A hub, a node out of reach and one that no source is; the blocks of a task give what rounds of joins give."""
    rng = random.Random(8)
    pairs = {(rng.randint(0, 149), rng.randint(0, 149)) for _ in range(300)} | {(i, 3) for i in range(100)} | {(3, i) for i in range(90, 150)} | {(7, 200)}
    edges, nodes = spark.createDataFrame(sorted(pairs), "src bigint, dst bigint"), spark.range(151).withColumnRenamed("id", "node")
    by_joins, by_tasks = (
        {tuple(r) for r in traversal.distance_profile(edges, nodes, words=8, task_links=n, task_words=1).collect()} for n in (0, 1000)
    )
    assert by_tasks == by_joins and sum(r[2] for r in by_tasks) == 151


def test_blocks_cost_no_jobs(spark):
    """All sources in one job, however many blocks they make: 700 sources are 11 blocks of 64."""
    edges = spark.range(700).selectExpr("id AS src", "(id + 1) % 700 AS dst").union(spark.range(700).selectExpr("id AS src", "(id * 7 + 3) % 700 AS dst"))
    spark.sparkContext.setJobGroup("walk", "")
    rows = traversal.distance_profile(edges, spark.range(700).withColumnRenamed("id", "node"), words=1).collect()
    assert sum(r["pairs"] for r in rows) == 700 * 699 and len(spark.sparkContext.statusTracker().getJobIdsForGroup("walk")) < 60
    spark.sparkContext.setJobGroup("", "")


def test_mean_of_a_long_way_round(spark):
    """600 nodes one way round: 599 steps to the last, which took rounds of joins for each step of each block."""
    edges = spark.range(600).selectExpr("id AS src", "(id + 1) % 600 AS dst")
    spark.sparkContext.setJobGroup("mean", "")
    rows = traversal.distance_profile(edges, spark.range(600).withColumnRenamed("id", "node")).collect()
    assert {r["hop"]: r["pairs"] for r in rows} == {0: 0} | dict.fromkeys(range(1, 600), 600) and rows[-1]["ended"] == 600
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("mean")) < 60
    spark.sparkContext.setJobGroup("", "")


def test_strong_components_in_a_task_are_those_of_joins(spark):
    """Random graphs, a long way round, a chain, a loop and a null end; in a task few jobs, which a round of joins each took."""
    rng = random.Random(3)
    pairs = {(rng.randint(0, 39), rng.randint(0, 39)) for _ in range(45)} | {(200 + i, 200 + (i + 1) % 7) for i in range(7)} | {(300 + i, 301 + i) for i in range(3)} | {(400, 400), (None, 401), (205, 5)}
    edges = spark.createDataFrame([*pairs, *list(pairs)[:20]], "src bigint, dst bigint")
    by_joins = {tuple(r) for r in traversal.strong_components(edges, task_links=0).collect()}
    spark.sparkContext.setJobGroup("strong", "")
    assert {tuple(r) for r in traversal.strong_components(edges).collect()} == by_joins and len(spark.sparkContext.statusTracker().getJobIdsForGroup("strong")) < 12
    spark.sparkContext.setJobGroup("", "")
    assert traversal.strong_components(edges.where("src < 0")).isEmpty()
    chain = spark.range(50_000).selectExpr("id AS src", "id + 1 AS dst")
    assert traversal.strong_components(chain).where("node = component").count() == 50_001


def test_weak_components_in_a_task_are_those_of_joins(spark):
    rng = random.Random(4)
    pairs = {(rng.randint(0, 99), rng.randint(0, 99)) for _ in range(60)} | {(200 + i, 200 + (i + 1) % 40) for i in range(40)} | {(400, 400), (None, 401)}
    edges = spark.createDataFrame(sorted(pairs, key=str), "src bigint, dst bigint")
    by_joins = {tuple(r) for r in connected_components(edges, task_edges=0).collect()}
    spark.sparkContext.setJobGroup("weak", "")
    assert {tuple(r) for r in connected_components(edges).collect()} == by_joins and len(spark.sparkContext.statusTracker().getJobIdsForGroup("weak")) < 12
    spark.sparkContext.setJobGroup("", "")
    assert connected_components(edges.where("src < 0")).isEmpty()
    chain = spark.range(50_000).selectExpr("id AS src", "id + 1 AS dst")
    assert connected_components(chain).where("component = 0").count() == 50_001

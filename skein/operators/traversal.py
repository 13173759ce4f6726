"""Bounded traversal, strong components and distances over edge tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import walks
from skein.functions.parts import TASK_EDGES, labelled, strong_parts
from skein.operators.chunking import numbered
from skein.operators.components import connected_components
from skein.session import checkpoint, discard, written


def hops(edges: DataFrame, seeds: DataFrame, max_hops: int, limit: int | None = None) -> DataFrame:
    """node, hop: the nodes within ``max_hops`` directed steps of any seed, seeds left out, with the least hop.

    ``edges`` has src and dst (give both directions for an undirected walk), ``seeds`` one column node. Each round joins
    the frontier with the edges and drops what was seen, so a node is expanded once. With ``limit`` the first nodes by
    hop and id are returned.
    """
    seen = written(seeds.select(F.col("node"), F.lit(0).alias("hop")).where("node IS NOT NULL").distinct())
    frontier, met = seen, 0
    for hop in range(1, max_hops + 1):
        reached = frontier.select(F.col("node").alias("src")).join(edges.select("src", "dst"), "src").select(F.col("dst").alias("node")).distinct()
        frontier = written(reached.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)))
        new = frontier.count()
        if not new:
            break
        seen, met = seen.unionByName(frontier), met + new
        if limit is not None and met >= limit:
            break  # nodes of a later hop come after all these
    found = seen.where("hop > 0")
    return found.orderBy("hop", "node").limit(limit) if limit is not None else found


def distances(edges: DataFrame, sources: DataFrame, max_hops: int = 1000) -> DataFrame:
    """source, node, hop: steps from each source of a stated set to every node it reaches, itself at 0."""
    seen = written(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("hop")).distinct())
    frontier = seen
    for hop in range(1, max_hops + 1):
        step = frontier.select("source", F.col("node").alias("src")).join(edges.select("src", "dst"), "src")
        reached = step.select("source", F.col("dst").alias("node")).distinct()
        frontier = written(reached.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError("distances go on beyond max_hops")


#: Distinct links that one broadcast holds, 4 bytes each, and the driver sorts, 8 bytes each; larger graphs are walked by joins.
TASK_LINKS = 20_000_000
#: Words of sources in a block of a task.
TASK_WORDS = 64


def _task_profile(links: DataFrame, nodes: DataFrame, words: int) -> list[tuple[int, int, int]]:
    """hop, pairs, ended: each task holds all links and takes its block of sources to the end."""
    spark = links.sparkSession
    ends = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
    placed = nodes.select("node", F.lit(0).alias("late")).union(ends.join(nodes, "node", "left_anti").select("node", F.lit(1)))
    placed = written(numbered(placed, ["late", "node"], "n"))  # the sources first
    total, n = placed.where("late = 0").count(), placed.count()
    at = lambda side: placed.select(F.col("node").alias(side), F.col("n").alias(f"{side}_n"))
    keys = links.join(at("src"), "src").join(at("dst"), "dst").select(F.shiftleft("dst_n", 32).bitwiseOR(F.col("src_n")).alias("key"))
    graph = spark.sparkContext.broadcast(walks.inward(keys.toArrow()["key"].to_numpy().copy(), n))
    discard(placed)
    size = 64 * walks.width(n, words)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in batch.column("id").to_pylist():
                rows = walks.block_profile(*graph.value, first, min(first + size, total))
                yield pa.RecordBatch.from_pylist([{"hop": h, "pairs": p, "ended": e} for h, p, e in rows], pa.schema([("hop", pa.int32()), ("pairs", pa.int64()), ("ended", pa.int64())]))

    blocks = -(-total // size)
    found = spark.range(0, total, size, max(1, blocks)).mapInArrow(walk, "hop int, pairs bigint, ended bigint") if total else None
    rows = [tuple(r) for r in found.groupBy("hop").agg(F.sum("pairs"), F.sum("ended")).orderBy("hop").collect()] if found is not None else [(0, 0, 0)]
    graph.destroy()
    return rows


def distance_profile(edges: DataFrame, nodes: DataFrame, words: int = 8, task_links: int = TASK_LINKS, task_words: int = TASK_WORDS) -> DataFrame:
    """hop, pairs, ended: how many pairs are that far apart, and how many nodes have their farthest node there.

    Every one of ``nodes`` is a source. Up to ``task_links`` distinct links are handed to every task as numbers, and a
    task walks a block of 64 * ``task_words`` sources to the end. With more links, blocks of 64 * ``words`` sources are
    walked one after the other: a node holds one bit for each source of the block that reaches it, so a round is one
    join and one bitwise aggregate however many sources there are.
    """
    schema = "hop int, pairs bigint, ended bigint"
    links = written(edges.select("src", "dst").where("src <> dst").distinct())
    if links.count() <= task_links:
        return edges.sparkSession.createDataFrame(_task_profile(links, nodes.select("node").where("node IS NOT NULL").distinct(), task_words), schema)
    size = 64 * words
    placed = checkpoint(numbered(nodes.select("node"), ["node"], "n"))
    names = [f"w{i}" for i in range(words)]
    either = [F.bit_or(w).alias(w) for w in names]
    pairs: Counter[int] = Counter({0: 0})
    ended: Counter[int] = Counter()
    total = placed.count()
    for start in range(0, total, size):
        at = F.col("n") - start
        bits = [F.when(F.floor(at / 64) == i, F.expr(f"shiftleft(1L, CAST((n - {start}) % 64 AS INT))")).otherwise(F.lit(0).cast("long")).alias(w) for i, w in enumerate(names)]
        seen = written(placed.where((at >= 0) & (at < size)).select("node", *bits))
        frontier, alive, hop = seen, (1 << min(size, total - start)) - 1, 0
        while alive:
            sent = frontier.withColumnRenamed("node", "src").join(links, "src").groupBy(F.col("dst").alias("node")).agg(*either)
            known = seen.select("node", *(F.col(w).alias(f"s{w}") for w in names))
            new = [F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(f"s{w}", F.lit(0).cast("long")))).alias(w) for w in names]
            fresh = written(sent.join(known, "node", "left").select("node", *new).where(" OR ".join(f"{w} <> 0" for w in names)))
            count = F.sum(sum((F.bit_count(w) for w in names[1:]), F.bit_count(names[0])))
            found, *masks = fresh.agg(count, *either).first()
            going = sum(((m or 0) & (2**64 - 1)) << (64 * i) for i, m in enumerate(masks))
            ended[hop] += (alive & ~going).bit_count()
            old, alive, frontier, hop = (seen, frontier), going, fresh, hop + 1
            if going:
                pairs[hop] += found
                seen = written(seen.unionByName(fresh).groupBy("node").agg(*either))
            discard(*old)
        discard(frontier)
    rows = [(h, pairs[h], ended[h]) for h in sorted(pairs)]
    return edges.sparkSession.createDataFrame(rows, schema)


def _spread(edges: DataFrame, labels: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """Carry the greatest label along the edges until nothing changes; with ``keep`` (node, mark) only inside one mark."""
    links = edges
    if keep is not None:
        links = edges.join(keep.select(F.col("node").alias("src"), F.col("mark").alias("a")), "src").join(keep.select(F.col("node").alias("dst"), F.col("mark").alias("b")), "dst").where("a = b").select("src", "dst")
        links = written(links)
    now, table = labels, None
    while True:
        sent = links.join(now.select(F.col("node").alias("src"), "label"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("label").alias("got"))
        moved = now.join(sent, "node", "left").select("node", F.greatest("label", F.coalesce("got", "label")).alias("label"), (F.col("got") > F.col("label")).alias("changed"))
        moved = written(moved)
        discard(table)
        table, now = moved, moved.select("node", "label")
        if moved.where("changed").isEmpty():
            return now


def strong_components(edges: DataFrame, max_rounds: int = 100, task_links: int = TASK_EDGES) -> DataFrame:
    """node, component: the greatest node of the strong component of every node of the edges.

    Up to ``task_links`` distinct links between numbers are taken by one task. Else forward-backward colouring: nodes
    without an edge in or out of what is left are components of their own; the greatest label is carried forwards, then
    back inside each colour from its root, and what it reaches is a component.
    """
    left = written(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    if {kind for _, kind in left.dtypes} <= {"bigint"} and left.count() <= task_links:
        return written(left.coalesce(1).mapInArrow(labelled(strong_parts), "node bigint, component bigint"))
    nodes = written(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct())
    left = written(left.where("src <> dst"))
    done = None
    for _ in range(max_rounds):
        while True:
            core = left.select(F.col("src").alias("node")).intersect(left.select(F.col("dst").alias("node")))
            core = written(core)
            slim = written(left.join(core.withColumnRenamed("node", "src"), "src", "left_semi").join(core.withColumnRenamed("node", "dst"), "dst", "left_semi"))
            alone = nodes.join(core, "node", "left_anti").select("node", F.col("node").alias("component"))
            found = written(alone)
            done = found if done is None else done.unionByName(found)
            nodes, trimmed, left = core, not found.isEmpty(), slim
            if not trimmed:
                break
        if nodes.isEmpty():
            return done
        colour = _spread(left, nodes.select("node", F.col("node").alias("label")))
        roots = colour.select("node", F.when(F.col("node") == F.col("label"), F.col("label")).alias("label"), F.col("label").alias("mark"))
        back = left.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        reached = _spread_from(back, roots)
        found = written(reached.select("node", F.col("mark").alias("component")))
        done = done.unionByName(found)
        nodes = written(nodes.join(found, "node", "left_anti"))
        left = written(left.join(found.select(F.col("node").alias("src")), "src", "left_anti").join(found.select(F.col("node").alias("dst")), "dst", "left_anti"))
    raise RuntimeError("strong components did not settle")


def _spread_from(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node, mark of the nodes that a root reaches inside its own mark."""
    marks = roots.select("node", "mark")
    inside = edges.join(marks.select(F.col("node").alias("src"), F.col("mark").alias("a")), "src").join(marks.select(F.col("node").alias("dst"), F.col("mark").alias("b")), "dst").where("a = b").select("src", "dst")
    inside = written(inside)
    seen = written(roots.where("label IS NOT NULL").select("node"))
    frontier = seen
    while True:
        reached = frontier.withColumnRenamed("node", "src").join(inside, "src").select(F.col("dst").alias("node")).distinct()
        frontier = written(reached.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            return marks.join(seen, "node", "left_semi")
        seen = seen.unionByName(frontier)


def largest(parts: DataFrame) -> DataFrame:
    """node of the largest component of (node, component), the least label on a tie."""
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return parts.join(F.broadcast(sizes.orderBy(F.desc("n"), "component").limit(1)), "component").select("node")


def component_statistics(edges: DataFrame) -> DataFrame:
    """One row: number and largest size of the weak and of the strong components."""
    weak = connected_components(edges).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    strong = strong_components(edges).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    w = weak.agg(F.count(F.lit(1)).alias("num_wcc"), F.max("n").alias("largest_wcc_size"))
    s = strong.agg(F.count(F.lit(1)).alias("num_scc"), F.max("n").alias("largest_scc_size"))
    return w.crossJoin(s)


def graph_statistics(edges: DataFrame, kind: str, nodes: DataFrame, levels: DataFrame) -> DataFrame:
    """One row: graph_type, nodes, relationships, communities of three levels, distances and components.

    ``edges`` has src and dst, directed; ``nodes`` node; ``levels`` node, level, community. The mean distance is that of
    the largest strong component along the edges, diameter and radius those of the largest weak one in both directions; a
    component of one node has 0.
    """
    plain = written(edges.select("src", "dst").distinct())
    both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    ways = written(plain.select(F.inline(both)).where("src <> dst").distinct())
    strong, weak = written(strong_components(plain)), written(connected_components(plain))
    core = largest(strong)
    inside = plain.join(core.withColumnRenamed("node", "src"), "src", "left_semi").join(core.withColumnRenamed("node", "dst"), "dst", "left_semi")
    far = distance_profile(inside, core).agg(F.round(F.coalesce(F.try_divide(F.sum(F.col("hop") * F.col("pairs")), F.sum("pairs")), F.lit(0.0)), 6).alias("mean_distance"))
    ends = distance_profile(ways, largest(weak)).where("ended > 0").agg(F.max("hop").alias("diameter"), F.min("hop").alias("radius"))
    sizes = lambda parts, name: parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias(f"num_{name}"), F.max("n").alias(f"largest_{name}_size"))
    counted = nodes.agg(F.count(F.lit(1)).alias("number_of_nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("number_of_relationships")))
    found = levels.agg(*(F.count_distinct(F.when(F.col("level") == k, F.col("community"))).alias(f"communities_level_{k + 1}") for k in range(3)))
    # Each side is one row.
    row = counted.crossJoin(found).crossJoin(far).crossJoin(ends).crossJoin(sizes(weak, "wcc")).crossJoin(sizes(strong, "scc"))
    return row.select(F.lit(kind).alias("graph_type"), *row.columns)

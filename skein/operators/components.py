"""Weak components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.parts import TASK_EDGES, labelled, weak_parts
from skein.session import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v): neighbours of ``u`` are joined to the least node around it."""
    if large:
        around = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = around.join(least, "u")
    if large:
        linked = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return linked.where(F.col("u") != F.col("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """node, component: the least node of the weak component of every node that an edge names.

    Edges may repeat, run both ways or be self loops; an edge with a null end is dropped. Up to
    ``task_edges`` distinct edges between numbers are taken by one task. Else the number of rounds grows with the
    logarithm of the largest component, and each round is two joins on the node. The minimum around a hub is aggregated
    on the map side; the join that hands it to the hub's neighbours is left to the adaptive skew join, which splits the
    hub's side. Each round is written, and the round before it removed.
    """
    plain = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    plain = written(plain.distinct())
    if {kind for _, kind in plain.dtypes} <= {"bigint"} and plain.count() <= task_edges:
        return written(plain.coalesce(1).mapInArrow(labelled(weak_parts), "node bigint, component bigint"))
    loops = plain.select("u").union(plain.select("v")).distinct()
    now = plain.where(F.col("u") != F.col("v"))
    seen = None
    for _ in range(max_rounds):
        before, now = now, written(_star(_star(now, True), False))
        discard(before)
        state = _state(now)
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return loops.join(now, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("component"))

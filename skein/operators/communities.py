"""Communities of three levels, their members and reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.partition import descent, potts_partition
from skein.operators.chunking import numbered
from skein.operators.components import connected_components
from skein.operators.retrieval import top_per_group
from skein.session import discard, written

#: Resolutions of the three levels, by kind of graph.
RESOLUTIONS = {"DL": (1e-5, 0.036, 0.6), "LLM": (3.5e-4, 0.0013, 0.8)}
OFFSETS = (0, 1000, 10000)
MIN_SIZE = 3


def objective(edges: DataFrame, labels: DataFrame, resolution: float) -> float:
    """Constant Potts value: weight inside communities less resolution times the pairs inside."""
    a = labels.select(F.col("node").alias("src"), F.col("label").alias("a"))
    b = labels.select(F.col("node").alias("dst"), F.col("label").alias("b"))
    inside = edges.where("src < dst").join(a, "src").join(b, "dst").where("a = b").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w")).first()["w"]
    pairs = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n - 1) / 2")), F.lit(0.0)).alias("p")).first()["p"]
    return float(inside) - resolution * float(pairs)


#: Directed edges of a part that one task divides from several starts, and from one; a task holds about 120 bytes for each.
#: Larger parts are contracted by joins until they have no more.
TASK_EDGES, ONCE_EDGES = 400_000, 6_000_000
#: Edges, about, of the parts that are divided one after the other, and groups of parts at once.
GROUP_EDGES, GROUPS = 20_000, 200


def _gains(links: DataFrame, sized: DataFrame, labels: DataFrame, resolution: float, turn: int) -> DataFrame:
    """node, label after one synchronous round: of the nodes that gain by moving, a seeded half goes where it gains most."""
    known = labels.join(sized, "node")
    sizes = known.groupBy("label").agg(F.sum("size").alias("total"))
    pull = links.join(labels.select(F.col("node").alias("dst"), F.col("label").alias("to")), "dst").groupBy(F.col("src").alias("node"), "to").agg(F.sum("weight").alias("w"))
    own = known.join(sizes, "label").select("node", "label", "size", (F.col("total") - F.col("size")).alias("rest"))
    offers = pull.join(sizes.select(F.col("label").alias("to"), "total"), "to").join(own, "node")
    value = F.col("w") - resolution * F.col("size") * F.when(F.col("to") == F.col("label"), F.col("rest")).otherwise(F.col("total"))
    scored = offers.withColumn("value", F.round(value, 9)).groupBy("node", "label", "rest", "size").agg(
        F.max_by("to", F.struct("value", F.col("to") == F.col("label"), "to")).alias("best_to"), F.max("value").alias("best_value"),
        F.max(F.when(F.col("to") == F.col("label"), F.col("value"))).alias("stay_value"),
    )
    stays = F.coalesce("stay_value", -resolution * F.col("size") * F.col("rest"))
    moves = scored.where((F.col("best_value") > stays) & (F.pmod(F.xxhash64(F.lit(turn), "node"), F.lit(2)) == 0)).select("node", "best_to")
    return labels.join(moves, "node", "left").select("node", F.coalesce("best_to", "label").alias("label"))


def _contracted(links: DataFrame, sized: DataFrame, resolution: float, patience: int = 4) -> DataFrame:
    """node, label: connected communities after local moving by joins, until ``patience`` rounds bring nothing better."""

    def value(labels: DataFrame) -> float:
        a, b = labels.select(F.col("node").alias("src"), F.col("label").alias("a")), labels.select(F.col("node").alias("dst"), F.col("label").alias("b"))
        inside = links.join(a, "src").join(b, "dst").where("a = b AND src < dst").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w")).first()["w"]
        squares = labels.join(sized, "node").groupBy("label").agg(F.sum("size").alias("t"), F.sum(F.col("size") * F.col("size")).alias("q")).agg(F.sum((F.col("t") * F.col("t") - F.col("q")) / 2).alias("p")).first()["p"]
        return float(inside) - resolution * float(squares or 0)

    labels = written(sized.select("node", F.col("node").alias("label")))
    best, best_value, stale, tables = labels, value(labels), 0, [labels]
    while stale < patience:
        tables.append(written(_gains(links, sized, labels, resolution, len(tables)).select("node", "label")))
        labels = tables[-1]
        reached = value(labels)
        if reached > best_value + 1e-12:
            best, best_value, stale = labels, reached, 0
        else:
            stale += 1
    discard(*(t for t in tables if t is not best))
    a, b = best.select(F.col("node").alias("src"), F.col("label").alias("a")), best.select(F.col("node").alias("dst"), F.col("label").alias("b"))
    joined = connected_components(links.join(a, "src").join(b, "dst").where("a = b"))
    return best.select("node").join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("label"))


def potts_communities(edges: DataFrame, nodes: DataFrame, resolution: float, seed: int = 7, task_edges: int = TASK_EDGES, once_edges: int = ONCE_EDGES) -> DataFrame:
    """node, label: communities under the constant Potts model, each connected.

    ``edges`` has src, dst, weight in both directions, ``nodes`` has node and parent; edges between parents do not
    count. A parent of at most ``task_edges`` edges is divided in a task, by moving, refinement and aggregation until
    nothing is gained, from several starts, one of at most ``once_edges`` from single nodes only. A larger one falls into
    its connected parts, as the model never joins what no edge joins. A part that is still larger is contracted: nodes move by joins and partial sums, so that no community or hub has to fit a
    task, each community becomes one node with its size, and so on until the part is small enough or nothing moves.
    """
    most = max(task_edges, once_edges)
    parent = nodes.select("node", "parent")
    ends = edges.join(parent.select(F.col("node").alias("src"), F.col("parent").alias("p")), "src").join(parent.select(F.col("node").alias("dst"), F.col("parent").alias("q")), "dst")
    links = written(ends.where("p = q AND src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.first("p").cast("string").alias("part")))
    home = parent.select("node", F.col("node").alias("top"), F.col("parent").cast("string").alias("part"))
    large = written(links.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("part"))
    if not large.isEmpty():
        whole = connected_components(links.join(large, "part", "left_semi")).select("node", F.concat(F.lit("of "), F.col("component").cast("string")).alias("own"))
        home = home.join(whole, "node", "left").select("node", "top", F.coalesce("own", "part").alias("part"))
        links = written(links.join(home.select(F.col("node").alias("src"), F.col("part").alias("own")), "src").select("src", "dst", "weight", F.col("own").alias("part")))
    home = written(home)
    sized = written(home.select("node", "part", F.lit(1.0).alias("size")))
    done: list[DataFrame] = []
    while True:
        counts = links.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("part")
        big = written(counts)
        if big.isEmpty():
            break
        inside = written(links.join(big, "part", "left_semi"))
        grown = sized.join(big, "part", "left_semi")
        labels = written(_contracted(inside, grown.select("node", "size"), resolution))
        before, after = labels.count(), labels.select("label").distinct().count()
        if after == before:
            done.append(labels)
            links, sized = written(links.join(big, "part", "left_anti")), written(sized.join(big, "part", "left_anti"))
            continue
        a, b = labels.select(F.col("node").alias("src"), F.col("label").alias("a")), labels.select(F.col("node").alias("dst"), F.col("label").alias("b"))
        merged = inside.join(a, "src").join(b, "dst").where("a <> b").groupBy("part", F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight"))
        sizes = grown.join(labels, "node").groupBy(F.col("label").alias("node"), "part").agg(F.sum("size").alias("size"))
        links = written(links.join(big, "part", "left_anti").unionByName(merged.select(*links.columns)))
        sized = written(sized.join(big, "part", "left_anti").unionByName(sizes.select(*sized.columns)))
        home = written(home.join(labels.select(F.col("node").alias("top"), "label"), "top", "left").select("node", F.coalesce("label", "top").alias("top"), "part"))

    def divide(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Of rows of edges and, with dst null, of nodes; numbered in the order of their ids."""
        alone = pc.is_null(part["dst"])
        own, ways = part.filter(alone).sort_by("src"), part.filter(pc.invert(alone))
        names = own["src"].to_numpy()
        at = [np.searchsorted(names, ways[c].to_numpy()).astype(np.int32) for c in ("src", "dst")]
        weight, size = ways["weight"].to_numpy(), own["weight"].to_numpy()
        label = potts_partition(*at, weight, size, resolution, seed) if len(weight) <= task_edges else descent(*at, weight, size, resolution, seed)
        # Named after their least nodes.
        first, back = np.unique(np.asarray(label), return_index=True, return_inverse=True)[1:]
        return names, names[first[back]]

    def divide_all(group: pa.Table) -> pa.Table:
        """Several parts; of small ones most of the time would go into a group for each."""
        part = group["part"].combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.argsort(part, kind="stable")
        ends = np.r_[0, np.flatnonzero(np.diff(part[order])) + 1, len(part)]
        group = group.drop_columns(["part"]) if len(ends) == 2 else group.drop_columns(["part"]).take(pa.array(order)).combine_chunks()
        found = [divide(group.slice(x, y - x)) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
        return pa.table({"node": np.concatenate([f[0] for f in found]), "label": np.concatenate([f[1] for f in found])})

    # An isolated node is a community; the others come with the edges of their part.
    linked = links.select("part").distinct()
    rows = links.select("part", "src", "dst", "weight").unionByName(sized.join(linked, "part", "left_semi").select("part", F.col("node").alias("src"), F.lit(None).cast("bigint").alias("dst"), F.col("size").alias("weight")))
    groups = max(24, links.count() // GROUP_EDGES)
    placed = rows.withColumn("group", F.pmod(F.xxhash64("part"), F.lit(groups))).repartition(min(groups, GROUPS), "group")
    found = placed.groupBy("group").applyInArrow(lambda t: divide_all(t.select(["part", "src", "dst", "weight"])), "node bigint, label bigint")
    for labels in done:
        found = found.unionByName(labels.select("node", "label"))
    named = home.join(found.select(F.col("node").alias("top"), "label"), "top", "left").select("node", F.coalesce("label", "top").alias("label"))
    return written(named)


def _number(found: DataFrame, offset: int) -> DataFrame:
    """node, community, parent: dense numbers from ``offset`` in the order of parent and label."""
    kinds = numbered(found.select("parent", "label").distinct(), ["parent", "label"], "k")
    return found.join(kinds.select("parent", "label", (F.col("k") + offset).alias("community")), ["parent", "label"]).select("node", "community", "parent")


def hierarchy(edges: DataFrame, kind: str = "DL", min_size: int = MIN_SIZE) -> DataFrame:
    """node, level, community, parent for three levels; communities under ``min_size`` are not divided further.

    ``edges`` has src, dst, weight in both directions. Numbers start at the offsets of the levels.
    """
    edges = written(edges)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    top = potts_communities(edges, nodes.withColumn("parent", F.lit(0)), RESOLUTIONS[kind][0])
    out, level = None, written(_number(top.withColumn("parent", F.lit(-1).cast("long")), OFFSETS[0]))
    for depth in range(3):
        part = level.select("node", F.lit(depth).alias("level"), "community", "parent")
        out = part if out is None else out.unionByName(part)
        if depth == 2:
            break
        sizes = level.groupBy("community").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size).select("community")
        inner = written(level.join(sizes, "community", "left_semi").select("node", F.col("community").alias("parent")))
        found = potts_communities(edges, inner, RESOLUTIONS[kind][depth + 1]).join(inner, "node")
        level = written(_number(found, OFFSETS[depth + 1]))
    return out


def communities(members: DataFrame) -> DataFrame:
    """community, level, parent, children, size, title from node, level, community, parent."""
    rows = members.groupBy("community", "level").agg(F.first("parent").alias("parent"), F.count(F.lit(1)).alias("size"))
    children = rows.where("level > 0").groupBy(F.col("parent").alias("community"), (F.col("level") - 1).alias("level")).agg(F.array_sort(F.collect_list("community")).alias("children"))
    empty = F.array().cast("array<bigint>")
    return rows.join(children, ["community", "level"], "left").select("community", "level", "parent", F.coalesce("children", empty).alias("children"), "size", F.concat(F.lit("Community "), "community").alias("title"))


def internal_relations(relations: DataFrame, members: DataFrame) -> DataFrame:
    """community, id: relations (id, source_id, target_id) with both ends in one community of (node, community)."""
    a = members.select(F.col("node").alias("source_id"), "community")
    b = members.select(F.col("node").alias("target_id"), F.col("community").alias("other"))
    return relations.join(a, "source_id").join(b, "target_id").where("community = other").select("community", "id")


def importance(mean_degree: Column, mean_weight: Column) -> Column:
    """0.7 * min(10, degree / 2) + 0.3 * min(10, 10 * weight), within 1 and 10, one place."""
    d = F.least(F.lit(10.0), F.coalesce(mean_degree, F.lit(0.0)) / 2)
    w = F.least(F.lit(10.0), 10 * F.coalesce(mean_weight, F.lit(0.0)))
    return F.round(F.greatest(F.lit(1.0), F.least(F.lit(10.0), 0.7 * d + 0.3 * w)), 1)


def reports(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """One report for each community.

    ``entities`` has community, title, entity_type, description, degree; ``relations`` has community, source, target,
    description, weight. Lists in a report are ranked and bounded (3 titles, 3 types, 10 relations), so the rows of a
    community never meet in one task unranked. Ties go to the first title, type or relation.
    """
    by_title = top_per_group(entities, ["community"], [F.desc_nulls_last("degree"), F.col("title")], 3)
    title = by_title.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda s: s["title"]), " and ").alias("title"), F.min_by("title", "rank").alias("key_entity"), F.min_by("degree", "rank").alias("key_degree"))
    kinds = entities.groupBy("community", "entity_type").agg(F.count(F.lit(1)).alias("n"))
    by_kind = top_per_group(kinds, ["community"], [F.desc("n"), F.asc_nulls_last("entity_type")], 3)
    named = F.concat(F.col("n").cast("string"), F.lit(" "), F.coalesce("entity_type", F.lit("None")))
    kind = by_kind.withColumn("line", named).groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda s: s["line"]), ", ").alias("kinds"), F.min_by(F.coalesce("entity_type", F.lit("None")), "rank").alias("modal_type"), F.min_by("n", "rank").alias("modal_n"))
    sizes = entities.groupBy("community").agg(F.count(F.lit(1)).alias("n_entities"), F.avg("degree").alias("mean_degree"))
    links = relations.groupBy("community").agg(F.count(F.lit(1)).alias("n_relations"), F.avg("weight").alias("mean_weight"), F.min_by(F.struct("source", "target", "description"), F.struct(-F.coalesce("weight", F.lit(-1.0)), "source", "target", "description")).alias("strongest"))
    rel_lines = top_per_group(relations, ["community"], [F.col("source"), F.col("target"), F.col("description")], 10)
    line = F.concat(F.lit("- "), "source", F.lit(" → "), F.coalesce("description", F.lit("")), F.lit(" → "), "target")
    key_relations = rel_lines.withColumn("line", line).groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda s: s["line"]), "\n").alias("key_relations"))
    all_parts = sizes.join(title, "community").join(kind, "community").join(links, "community", "left").join(key_relations, "community", "left")
    n_rel = F.coalesce("n_relations", F.lit(0))
    rank = importance(F.col("mean_degree"), F.col("mean_weight"))
    text = lambda c: F.col(c).cast("string")
    summary = F.concat(F.lit("This community contains "), text("n_entities"), F.lit(" entities ("), "kinds", F.lit(") with "), n_rel.cast("string"), F.lit(" relationships. The main entities include "), "title", F.lit("."))
    findings = F.filter(
        F.array(
            F.concat("key_entity", F.lit(" is a key entity in this community with "), text("key_degree"), F.lit(" connections.")),
            F.concat(F.lit("The strongest relationship is between "), F.col("strongest.source"), F.lit(" and "), F.col("strongest.target"), F.lit(" ("), F.coalesce(F.col("strongest.description"), F.lit("")), F.lit(").")),
            F.concat(F.lit("The most common entity type is "), "modal_type", F.lit(" with "), text("modal_n"), F.lit(" instances.")),
        ),
        lambda x: x.isNotNull(),
    )
    rating = F.concat(F.lit("The impact severity rating is "), F.when(rank >= 7.5, "high").otherwise("medium"), F.lit(" due to the "), text("n_entities"), F.lit(" entities and "), n_rel.cast("string"), F.lit(" relationships in this community."))
    return all_parts.select("community", "title", summary.alias("summary"), rank.alias("rank"), rating.alias("rating_explanation"), findings.alias("findings"), F.concat(F.lit("# "), "title", F.lit("\n\n"), summary, F.lit("\n\n## Key Relationships\n\n"), F.coalesce("key_relations", F.lit(""))).alias("full_content"))


def with_reports(rows: DataFrame, found: DataFrame, key: str = "community") -> DataFrame:
    """Communities with the columns that only the reports have; a community without report gets "", 0, []."""
    fresh = [f for f in found.schema.fields if f.name not in rows.columns]
    joined = rows.join(found.select(key, *(f.name for f in fresh)), key, "left")
    empty = {"string": F.lit(""), "int": F.lit(0), "bigint": F.lit(0), "double": F.lit(0.0)}
    return joined.select(*rows.columns, *(F.coalesce(f.name, empty.get(f.dataType.simpleString(), F.array().cast(f.dataType) if f.dataType.simpleString().startswith("array") else F.lit(None).cast(f.dataType))).alias(f.name) for f in fresh))


def cross_community(relations: DataFrame, members: DataFrame, limit: int | None = None, both_directions: bool = False) -> DataFrame:
    """Relations (id, source_id, target_id, weight) whose ends lie in different communities, the heaviest first.

    A node in several communities counts to the best ranked, which ``members`` (node, community, position) says.
    """
    home = members.groupBy("node").agg(F.min_by("community", F.struct("position", "community")).alias("community"))
    a = home.select(F.col("node").alias("source_id"), F.col("community").alias("source_community"))
    b = home.select(F.col("node").alias("target_id"), F.col("community").alias("target_community"))
    found = relations.join(a, "source_id").join(b, "target_id").where("source_community <> target_community").select("id", "source_id", "source_community", "target_id", "target_community", "weight")
    if both_directions:
        found = found.unionByName(found.select("id", F.col("target_id").alias("source_id"), F.col("target_community").alias("source_community"), F.col("source_id").alias("target_id"), F.col("source_community").alias("target_community"), "weight"))
    return found.orderBy(F.desc(F.coalesce("weight", F.lit(0.0))), "id", "source_id").limit(limit) if limit is not None else found


def layout(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key, x, y by the first two principal components; the sign of each is that of its largest loading."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    fitted = PCA(k=2, inputCol="v", outputCol="p").fit(rows)
    load = fitted.pc.toArray()
    signs = [1.0 if load[abs(load[:, j]).argmax(), j] > 0 else -1.0 for j in range(2)]
    at = vector_to_array("p")
    return fitted.transform(rows).select(key, (at[0] * signs[0]).alias("x"), (at[1] * signs[1]).alias("y"))


def grid_layout(rows: DataFrame, order: list[str]) -> DataFrame:
    """x, y on a grid ten wide, for want of vectors."""
    return numbered(rows, order, "_i").select(*rows.columns, (F.col("_i") % 10).cast("double").alias("x"), F.floor(F.col("_i") / 10).cast("double").alias("y"))

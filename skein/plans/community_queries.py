"""Queries over the graph's structure: components, distances, communities and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import communities as C
from skein.operators import graph, traversal
from skein.operators.components import connected_components
from skein.operators.retrieval import top_per_group
from skein.plans.tables import table

EVERY = 20


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    """Directed distinct src, dst over the readable numbers of the entities."""
    numbers = table(spark, folder, "entities").select("id", F.col("human_readable_id").alias("n"))
    found = graph.related_edges(table(spark, folder, "relationships"), table(spark, folder, "entities"))
    a, b = numbers.withColumnsRenamed({"id": "source_id", "n": "src"}), numbers.withColumnsRenamed({"id": "target_id", "n": "dst"})
    return found.join(a, "source_id").join(b, "target_id").select("src", "dst", "weight", "id")


def _ways(spark: SparkSession, folder: str) -> DataFrame:
    return graph.undirected(_edges(spark, folder), "src", "dst")


def _seeds(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "entities").where(F.col("human_readable_id") % EVERY == 0).select(F.col("human_readable_id").alias("node"))


def wcc(spark: SparkSession, folder: str) -> DataFrame:
    return connected_components(_edges(spark, folder)).select("node", "component")


def scc(spark: SparkSession, folder: str) -> DataFrame:
    return traversal.strong_components(_edges(spark, folder)).select("node", "component")


def component_stats(spark: SparkSession, folder: str) -> DataFrame:
    return traversal.component_statistics(_edges(spark, folder))


def bfs_hops(spark: SparkSession, folder: str) -> DataFrame:
    """Least hops, up to four, from the entities with a number divisible by 20, whatever the direction."""
    return traversal.hops(_ways(spark, folder), _seeds(spark, folder), 4)


def mean_distance(spark: SparkSession, folder: str) -> DataFrame:
    """Directed steps between all pairs of the largest strong component."""
    edges = _edges(spark, folder).select("src", "dst").distinct()
    core = traversal.largest(traversal.strong_components(edges))
    inside = edges.join(core.withColumnRenamed("node", "src"), "src", "left_semi").join(core.withColumnRenamed("node", "dst"), "dst", "left_semi")
    found = traversal.distance_profile(inside, core)
    return found.agg(F.sum("pairs").alias("pairs"), F.round(F.try_divide(F.sum(F.col("hop") * F.col("pairs")), F.sum("pairs")), 6).alias("mean_distance"))


def ecc_diameter_radius(spark: SparkSession, folder: str) -> DataFrame:
    """Greatest and least eccentricity of the nodes of the largest weak component."""
    ways = _ways(spark, folder)
    core = traversal.largest(connected_components(ways))
    return traversal.distance_profile(ways, core).where("ended > 0").agg(F.max("hop").alias("diameter"), F.min("hop").alias("radius"))


def communities_cpm(spark: SparkSession, folder: str) -> DataFrame:
    edges = _edges(spark, folder)
    weight = F.least(F.lit(1.0), F.greatest(F.lit(0.1), F.coalesce("weight", F.lit(0.1))))
    one = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), weight.alias("weight")).groupBy("a", "b").agg(F.max("weight").alias("weight"))
    both = one.select(F.inline(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "weight"), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))))
    return C.communities(C.hierarchy(both)).select("community", "level", "parent", "children", "size")


def _members(spark: SparkSession, folder: str) -> DataFrame:
    """Entities with the first letter of their title as community, which SQL can say too."""
    return table(spark, folder, "entities").withColumn("community", F.substring("title", 1, 1))


def _inside(spark: SparkSession, folder: str) -> DataFrame:
    """Relations whose ends share a community."""
    found = graph.related_edges(table(spark, folder, "relationships"), table(spark, folder, "entities"))
    names = _members(spark, folder).select("id", "title", "community")
    a = names.select(F.col("id").alias("source_id"), F.col("title").alias("source"), "community")
    b = names.select(F.col("id").alias("target_id"), F.col("title").alias("target"), F.col("community").alias("other"))
    return found.join(a, "source_id").join(b, "target_id").where("community = other")


def community_members(spark: SparkSession, folder: str) -> DataFrame:
    members = _members(spark, folder).select("community", "id")
    return members.join(members.groupBy("community").agg(F.count(F.lit(1)).alias("size")), "community")


def internal_relations(spark: SparkSession, folder: str) -> DataFrame:
    found = graph.related_edges(table(spark, folder, "relationships"), table(spark, folder, "entities"))
    return C.internal_relations(found, _members(spark, folder).select(F.col("id").alias("node"), "community"))


def community_text_units(spark: SparkSession, folder: str) -> DataFrame:
    return _members(spark, folder).select("community", F.explode("text_unit_ids").alias("unit")).distinct()


def community_title_top3(spark: SparkSession, folder: str) -> DataFrame:
    return top_per_group(_members(spark, folder).select("community", "title", "degree"), ["community"], [F.desc_nulls_last("degree"), F.col("title")], 3).select("community", "rank", "title")


def type_histogram(spark: SparkSession, folder: str) -> DataFrame:
    kinds = _members(spark, folder).groupBy("community", "entity_type").agg(F.count(F.lit(1)).alias("n"))
    return top_per_group(kinds, ["community"], [F.desc("n"), F.asc_nulls_last("entity_type")], 3).select("community", "rank", "entity_type", "n")


def importance_score(spark: SparkSession, folder: str) -> DataFrame:
    d = _members(spark, folder).groupBy("community").agg(F.avg("degree").alias("d"))
    w = _inside(spark, folder).groupBy("community").agg(F.avg("weight").alias("w"))
    return d.join(w, "community", "left").select("community", C.importance(F.col("d"), F.col("w")).alias("rank"))


def community_report_template(spark: SparkSession, folder: str) -> DataFrame:
    found = C.reports(_members(spark, folder).select("community", "title", "entity_type", "description", "degree"), _inside(spark, folder).select("community", "source", "target", "description", "weight"))
    return found.select("community", "title", "summary", "rank", "rating_explanation", F.array_join("findings", " | ").alias("findings"), F.md5("full_content").alias("content"))


def communities_with_reports(spark: SparkSession, folder: str) -> DataFrame:
    """All letters with the reports of those that have more than ten members; the others get the typed defaults."""
    rows = _members(spark, folder).groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    found = C.reports(_members(spark, folder).select("community", "title", "entity_type", "description", "degree"), _inside(spark, folder).select("community", "source", "target", "description", "weight"))
    big = rows.where("size > 10").select("community")
    return C.with_reports(rows, found.join(big, "community", "left_semi").select("community", "title", "rank"))


def community_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Regions, nations and suppliers as communities of three levels, each with its parent's name and its children."""
    region, nation, supplier = (table(spark, folder, n) for n in ("region", "nation", "supplier"))
    rows = (
        region.select(F.lit(0).alias("level"), F.col("r_regionkey").cast("long").alias("community"), F.lit(-1).cast("long").alias("parent"), F.col("r_name").alias("name"))
        .unionByName(nation.select(F.lit(1).alias("level"), (F.col("n_nationkey") + 1000).cast("long").alias("community"), F.col("n_regionkey").cast("long").alias("parent"), F.col("n_name").alias("name")))
        .unionByName(supplier.select(F.lit(2).alias("level"), (F.col("s_suppkey") + 10000).alias("community"), (F.col("s_nationkey") + 1000).cast("long").alias("parent"), F.col("s_name").alias("name")))
    )
    above = rows.select(F.col("community").alias("parent"), F.col("name").alias("parent_name"))
    below = rows.where("parent >= 0").groupBy(F.col("parent").alias("community")).agg(F.count(F.lit(1)).alias("children"))
    return rows.join(above, "parent", "left").join(below, "community", "left").select("level", "community", "name", "parent_name", F.coalesce("children", F.lit(0)).alias("children"))


def cross_community_edges(spark: SparkSession, folder: str) -> DataFrame:
    found = graph.related_edges(table(spark, folder, "relationships"), table(spark, folder, "entities"))
    home = _members(spark, folder).select(F.col("id").alias("node"), "community", F.lit(0).alias("position"))
    return C.cross_community(found, home).groupBy("source_community", "target_community").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(F.coalesce("weight", F.lit(0.0))), 6).alias("heaviest"))


def cross_community_top(spark: SparkSession, folder: str) -> DataFrame:
    found = graph.related_edges(table(spark, folder, "relationships"), table(spark, folder, "entities"))
    home = _members(spark, folder).select(F.col("id").alias("node"), "community", F.lit(0).alias("position"))
    return C.cross_community(found, home, 10).select("id", "source_community", "target_community")


def graph_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes, relations and the number of communities by letter, as one row."""
    entities, edges = table(spark, folder, "entities"), _edges(spark, folder)
    a = entities.agg(F.count(F.lit(1)).alias("number_of_nodes"), F.count_distinct(F.substring("title", 1, 1)).alias("communities"))
    return a.crossJoin(edges.agg(F.count(F.lit(1)).alias("number_of_relationships")))


def community_layout(spark: SparkSession, folder: str) -> DataFrame:
    """Two principal components of the vectors; compared by their spread, as signs are free."""
    found = C.layout(table(spark, folder, "embeddings"), "vec_id", "embedding")
    return found.select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def first_relations(spark: SparkSession, folder: str) -> DataFrame:
    """The first ten relations of each community, by number and id."""
    return top_per_group(_inside(spark, folder).select("community", "id"), ["community"], [F.col("id")], 10)


QUERIES = {
    f.__name__: f
    for f in (wcc, scc, component_stats, bfs_hops, mean_distance, ecc_diameter_radius, communities_cpm, community_members, internal_relations, community_text_units, community_title_top3, type_histogram,
              importance_score, community_report_template, communities_with_reports, community_hierarchy, cross_community_edges, cross_community_top, graph_stats, community_layout, first_relations)
}

_E = """k AS (SELECT * FROM (SELECT id, human_readable_id AS n, left(title, 1) AS c, title, upper(trim(title)) AS t, row_number() OVER (PARTITION BY upper(trim(title)) ORDER BY human_readable_id, id) AS o FROM entities) WHERE o = 1),
e AS (SELECT r.id, a.n AS src, b.n AS dst, a.id AS sid, b.id AS tid, a.c AS ca, b.c AS cb, a.title AS source, b.title AS target, r.description, r.weight FROM relationships r JOIN k a ON a.t = upper(trim(source_title)) JOIN k b ON b.t = upper(trim(target_title))),
u AS (SELECT DISTINCT * FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) WHERE src <> dst),
nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"""
_WCC = f"WITH RECURSIVE {_E}, w AS (SELECT node, node AS other FROM nodes UNION SELECT w.node, u.dst FROM w JOIN u ON u.src = w.other), c AS (SELECT node, min(other) AS component FROM w GROUP BY node)"
_SCC = f"WITH RECURSIVE {_E}, d AS (SELECT DISTINCT src, dst FROM e), w AS (SELECT node, node AS other FROM nodes UNION SELECT w.node, d.dst FROM w JOIN d ON d.src = w.other), s AS (SELECT a.node, max(a.other) AS component FROM w a JOIN w b ON a.node = b.other AND a.other = b.node GROUP BY a.node)"
_M = "m AS (SELECT *, left(title, 1) AS community FROM entities)"
_TITLES = "tt AS (SELECT community, string_agg(title, ' and ' ORDER BY k) AS title FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY degree DESC NULLS LAST, title) AS k FROM m) WHERE k <= 3 GROUP BY community)"
_KINDS = "kk AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, entity_type NULLS LAST) AS rank FROM (SELECT community, entity_type, count(*) AS n FROM m GROUP BY ALL))"
_RANK = "rk AS (SELECT community, round(greatest(1, least(10, 0.7 * least(10, d / 2) + 0.3 * least(10, 10 * coalesce(w, 0)))), 1) AS rank, n, coalesce(r, 0) AS r FROM (SELECT community, avg(degree) AS d, count(*) AS n FROM m GROUP BY community) LEFT JOIN (SELECT ca AS community, avg(weight) AS w, count(*) AS r FROM e WHERE ca = cb GROUP BY ca) USING (community))"

SQL = {
    "wcc": f"{_WCC} SELECT node, component FROM c",
    "scc": f"{_SCC} SELECT node, component FROM s",
    "component_stats": f"""{_SCC}, x AS (SELECT DISTINCT src, dst FROM u), w2 AS (SELECT node, node AS other FROM nodes UNION SELECT w2.node, x.dst FROM w2 JOIN x ON x.src = w2.other), c AS (SELECT node, min(other) AS component FROM w2 GROUP BY node)
        SELECT (SELECT count(DISTINCT component) FROM c) AS num_wcc, (SELECT max(n) FROM (SELECT count(*) AS n FROM c GROUP BY component)) AS largest_wcc_size, (SELECT count(DISTINCT component) FROM s) AS num_scc, (SELECT max(n) FROM (SELECT count(*) AS n FROM s GROUP BY component)) AS largest_scc_size""",
    "bfs_hops": f"""WITH RECURSIVE {_E}, h AS (SELECT human_readable_id AS node, 0 AS hop FROM entities WHERE human_readable_id % 20 = 0 UNION SELECT u.dst, hop + 1 FROM h JOIN u ON u.src = h.node WHERE hop < 4)
        SELECT node, CAST(min(hop) AS INTEGER) AS hop FROM h GROUP BY node HAVING min(hop) > 0""",
    "mean_distance": f"""{_SCC}, big AS (SELECT component FROM s GROUP BY component ORDER BY count(*) DESC, component LIMIT 1), core AS (SELECT node FROM s JOIN big USING (component)), ie AS (SELECT src, dst FROM d WHERE src IN (SELECT node FROM core) AND dst IN (SELECT node FROM core)),
        h AS (SELECT node AS source, node, 0 AS hop FROM core UNION SELECT h.source, ie.dst, hop + 1 FROM h JOIN ie ON ie.src = h.node WHERE hop < 30), b AS (SELECT source, node, min(hop) AS hop FROM h GROUP BY ALL) SELECT count(*) AS pairs, round(avg(hop), 6) AS mean_distance FROM b WHERE hop > 0""",
    "ecc_diameter_radius": f"""{_WCC}, big AS (SELECT component FROM c GROUP BY component ORDER BY count(*) DESC, component LIMIT 1), h AS (SELECT node AS source, node, 0 AS hop FROM c JOIN big USING (component) UNION SELECT h.source, u.dst, hop + 1 FROM h JOIN u ON u.src = h.node WHERE hop < 20),
        b AS (SELECT source, node, min(hop) AS hop FROM h GROUP BY ALL), x AS (SELECT source, max(hop) AS ecc FROM b GROUP BY source) SELECT CAST(max(ecc) AS INTEGER) AS diameter, CAST(min(ecc) AS INTEGER) AS radius FROM x""",
    "community_members": f"WITH {_M} SELECT community, id, count(*) OVER (PARTITION BY community) AS size FROM m",
    "internal_relations": f"WITH {_E} SELECT ca AS community, id FROM e WHERE ca = cb",
    "community_text_units": f"WITH {_M} SELECT DISTINCT community, unnest(text_unit_ids) AS unit FROM m",
    "community_title_top3": f"WITH {_M} SELECT community, rank, title FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY degree DESC NULLS LAST, title) AS rank FROM m) WHERE rank <= 3",
    "type_histogram": f"WITH {_M}, {_KINDS} SELECT community, rank, entity_type, n FROM kk WHERE rank <= 3",
    "importance_score": f"WITH {_M}, {_E}, {_RANK} SELECT community, rank FROM rk",
    "community_report_template": f"""WITH {_M}, {_E}, {_RANK}, {_TITLES}, {_KINDS}, ks AS (SELECT community, string_agg(n || ' ' || coalesce(entity_type, 'None'), ', ' ORDER BY rank) AS kinds, max(CASE WHEN rank = 1 THEN 'The most common entity type is ' || coalesce(entity_type, 'None') || ' with ' || n || ' instances.' END) AS third FROM kk WHERE rank <= 3 GROUP BY community),
        ke AS (SELECT community, title || ' is a key entity in this community with ' || degree || ' connections.' AS first FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY degree DESC NULLS LAST, title) AS k FROM m) WHERE k = 1),
        st AS (SELECT community, 'The strongest relationship is between ' || source || ' and ' || target || ' (' || coalesce(description, '') || ').' AS second FROM (SELECT *, ca AS community, row_number() OVER (PARTITION BY ca ORDER BY coalesce(weight, -1) DESC, source, target, description NULLS FIRST) AS k FROM e WHERE ca = cb) WHERE k = 1),
        kr AS (SELECT community, string_agg('- ' || source || ' → ' || coalesce(description, '') || ' → ' || target, chr(10) ORDER BY k) AS lines FROM (SELECT *, ca AS community, row_number() OVER (PARTITION BY ca ORDER BY source, target, description NULLS FIRST) AS k FROM e WHERE ca = cb) WHERE k <= 10 GROUP BY community),
        al AS (SELECT *, 'This community contains ' || n || ' entities (' || kinds || ') with ' || r || ' relationships. The main entities include ' || title || '.' AS summary FROM rk JOIN tt USING (community) JOIN ks USING (community) JOIN ke USING (community) LEFT JOIN st USING (community) LEFT JOIN kr USING (community))
        SELECT community, title, summary, rank, 'The impact severity rating is ' || CASE WHEN rank >= 7.5 THEN 'high' ELSE 'medium' END || ' due to the ' || n || ' entities and ' || r || ' relationships in this community.' AS rating_explanation,
        concat_ws(' | ', first, second, third) AS findings, md5('# ' || title || chr(10) || chr(10) || summary || chr(10) || chr(10) || '## Key Relationships' || chr(10) || chr(10) || coalesce(lines, '')) AS content FROM al""",
    "communities_with_reports": f"WITH {_M}, {_E}, {_RANK}, {_TITLES} SELECT community, n AS size, CASE WHEN n > 10 THEN title ELSE '' END AS title, CASE WHEN n > 10 THEN rank ELSE 0 END AS rank FROM rk JOIN tt USING (community)",
    "community_hierarchy": """WITH r AS (SELECT 0 AS level, CAST(r_regionkey AS BIGINT) AS community, CAST(-1 AS BIGINT) AS parent, r_name AS name FROM region UNION ALL SELECT 1, n_nationkey + 1000, n_regionkey, n_name FROM nation UNION ALL SELECT 2, s_suppkey + 10000, s_nationkey + 1000, s_name FROM supplier)
        SELECT a.level, a.community, a.name, b.name AS parent_name, (SELECT count(*) FROM r c WHERE c.parent = a.community) AS children FROM r a LEFT JOIN r b ON b.community = a.parent""",
    "cross_community_edges": f"WITH {_E} SELECT ca AS source_community, cb AS target_community, count(*) AS n, round(max(coalesce(weight, 0)), 6) AS heaviest FROM e WHERE ca <> cb GROUP BY ALL",
    "cross_community_top": f"WITH {_E} SELECT id, ca AS source_community, cb AS target_community FROM e WHERE ca <> cb ORDER BY coalesce(weight, 0) DESC, id, sid LIMIT 10",
    "graph_stats": f"WITH {_E} SELECT (SELECT count(*) FROM entities) AS number_of_nodes, (SELECT count(DISTINCT left(title, 1)) FROM entities) AS communities, (SELECT count(*) FROM e) AS number_of_relationships",
    "first_relations": f"WITH {_E} SELECT community, id, rank FROM (SELECT ca AS community, id, row_number() OVER (PARTITION BY ca ORDER BY id) AS rank FROM e WHERE ca = cb) WHERE rank <= 10",
}

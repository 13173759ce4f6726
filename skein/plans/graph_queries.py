"""Queries that build the graph and resolve its names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import normal_name
from skein.operators import graph, resolution
from skein.plans.tables import table

ENDS = ("source_title", "target_title")


def _relations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "relationships")


def _triplets(spark: SparkSession, folder: str) -> DataFrame:
    """Relations as triplets, with the types that the entities of their ends have."""
    rel = _relations(spark, folder)
    kinds = table(spark, folder, "entities").select(graph.title_of(F.col("title")).alias("_n"), "entity_type")
    named = rel.select("id", "human_readable_id", F.trim("source_title").alias("head"), F.trim("target_title").alias("tail"), "relation_type")
    for side in ("head", "tail"):
        named = named.join(kinds.select("_n", F.col("entity_type").alias(f"{side}_type")), F.upper(side) == F.col("_n"), "left").drop("_n")
    return named


def triplet_filter(spark: SparkSession, folder: str) -> DataFrame:
    rel = _relations(spark, folder).select("id", "human_readable_id", *ENDS, F.coalesce(F.get("text_unit_ids", F.lit(0)), F.lit("")).alias("unit"))
    return graph.filter_triplets(rel, ["unit"], ["human_readable_id", "id"], *ENDS).select("id", "unit")


def complete_triplets(spark: SparkSession, folder: str) -> DataFrame:
    """Both ways to find self loops: as written, and in upper case."""
    rel = _relations(spark, folder).where(F.col(ENDS[0]).isNotNull() & F.col(ENDS[1]).isNotNull() & F.col("relation_type").isNotNull())
    return rel.select("id", (F.col(ENDS[0]) == F.col(ENDS[1])).alias("same_raw"), (graph.title_of(F.col(ENDS[0])) == graph.title_of(F.col(ENDS[1]))).alias("same_upper"))


def relation_validity(spark: SparkSession, folder: str) -> DataFrame:
    return graph.valid_relations(_relations(spark, folder), *ENDS, "relation_type", "weight").select("id", "weight")


def entity_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return graph.mentions(_relations(spark, folder), *ENDS).groupBy("title").agg(F.count(F.lit(1)).alias("frequency"))


def entity_first_wins(spark: SparkSession, folder: str) -> DataFrame:
    return graph.entity_attributes(_relations(spark, folder), *ENDS, "human_readable_id", "relation_type", "description")


def entity_chunks(spark: SparkSession, folder: str) -> DataFrame:
    rows = graph.mentions(_relations(spark, folder), *ENDS, "text_unit_ids")
    return rows.select("title", F.explode("text_unit_ids").alias("unit")).groupBy("title").agg(F.array_sort(F.collect_set("unit")).alias("units"))


def entity_degree(spark: SparkSession, folder: str) -> DataFrame:
    return graph.degrees(_relations(spark, folder), *ENDS)


def combined_degree(spark: SparkSession, folder: str) -> DataFrame:
    return graph.combined_degrees(_relations(spark, folder), "id", *ENDS)


def stale_degrees(spark: SparkSession, folder: str) -> DataFrame:
    """Relations whose stored combined degree is not what the table gives."""
    rel = _relations(spark, folder)
    found = graph.combined_degrees(rel, "id", *ENDS)
    return rel.select("id", F.col("combined_degree").alias("stored")).join(found, "id").where(~F.col("stored").eqNullSafe(F.col("combined_degree"))).select("id", "stored", "combined_degree")


def chunk_inverted_index(spark: SparkSession, folder: str) -> DataFrame:
    entities = graph.inverted_index(table(spark, folder, "entities"), "id", "text_unit_ids", "entity_ids")
    relations = graph.inverted_index(_relations(spark, folder), "id", "text_unit_ids", "relationship_ids")
    empty = F.array().cast("array<string>")
    return entities.join(relations, "unit", "full").select("unit", F.coalesce("entity_ids", empty).alias("entity_ids"), F.coalesce("relationship_ids", empty).alias("relationship_ids"))


def has_entity(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "entities").select(F.col("id").alias("entity_id"), F.explode("text_unit_ids").alias("unit")).distinct()


def part_of(spark: SparkSession, folder: str) -> DataFrame:
    from skein.operators.chunking import token_windows

    return token_windows(table(spark, folder, "documents"), "doc_id", "text").select("chunk_id", "doc_id").distinct()


def related(spark: SparkSession, folder: str) -> DataFrame:
    return graph.related_edges(_relations(spark, folder), table(spark, folder, "entities")).select("id", "source_id", "target_id")


def dangling_relations(spark: SparkSession, folder: str) -> DataFrame:
    return graph.dangling(_relations(spark, folder), table(spark, folder, "entities"))


def relation_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Relations by cleaned type: two spellings of one type meet."""
    kind = F.regexp_replace(F.lower(F.trim("relation_type")), r"[\s\-]+", "_")
    return _relations(spark, folder).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("weight"), 6).alias("mean_weight"))


def mention_groups(spark: SparkSession, folder: str) -> DataFrame:
    return resolution.mention_counts(_triplets(spark, folder))


def mention_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return resolution.similar_names(table(spark, folder, "entities").select(normal_name(F.col("title")).alias("name")))


def weighted_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of entity names with a weighted ratio of 85 or more."""
    return resolution.weighted_names(table(spark, folder, "entities").select(normal_name(F.col("title")).alias("name"))).withColumn("score", F.round("score", 6))


def canonical_form(spark: SparkSession, folder: str) -> DataFrame:
    counts = resolution.mention_counts(_triplets(spark, folder)).withColumn("name", normal_name(F.col("mention")))
    return resolution.canonical_forms(counts, "name")


def apply_canonical(spark: SparkSession, folder: str) -> DataFrame:
    rows = _triplets(spark, folder)
    counts = resolution.mention_counts(rows).withColumn("name", normal_name(F.col("mention")))
    forms = counts.join(resolution.canonical_forms(counts, "name"), "name").select("mention", "type", "canonical")
    return resolution.apply_canonical(rows, forms).select("id", "head", "tail")


def resolve_entities(spark: SparkSession, folder: str) -> DataFrame:
    return resolution.resolve(_triplets(spark, folder)).select("id", "head", "tail")


QUERIES = {
    f.__name__: f
    for f in (triplet_filter, complete_triplets, relation_validity, entity_frequency, entity_first_wins, entity_chunks, entity_degree, combined_degree, stale_degrees, chunk_inverted_index,
              has_entity, part_of, related, dangling_relations, relation_kinds, mention_groups, mention_pairs, weighted_pairs, canonical_form, apply_canonical, resolve_entities)
}

_M = """m AS (SELECT upper(trim(source_title)) AS title, 0 AS side, * FROM relationships WHERE length(trim(source_title)) > 0
  UNION ALL SELECT upper(trim(target_title)), 1, * FROM relationships WHERE length(trim(target_title)) > 0)"""
_DEG = f"{_M}, d AS (SELECT title, count(*) AS degree FROM m GROUP BY title), cd AS (SELECT r.id, r.combined_degree AS stored, coalesce(a.degree, 0) + coalesce(b.degree, 0) AS combined_degree FROM relationships r LEFT JOIN d a ON a.title = upper(trim(source_title)) LEFT JOIN d b ON b.title = upper(trim(target_title)))"
_TRI = """t AS (SELECT r.id, trim(source_title) AS head, trim(target_title) AS tail, a.entity_type AS head_type, b.entity_type AS tail_type FROM relationships r
  LEFT JOIN entities a ON upper(trim(a.title)) = upper(trim(source_title)) LEFT JOIN entities b ON upper(trim(b.title)) = upper(trim(target_title))),
mc AS (SELECT mention, type, count(*) AS freq FROM (SELECT head AS mention, head_type AS type FROM t UNION ALL SELECT tail, tail_type FROM t) WHERE length(mention) > 0 GROUP BY ALL),
nm AS (SELECT *, regexp_replace(lower(trim(mention)), '^(the|a|an|la|el|los|las)[ \\t\\n\\r\\f]+', '') AS name FROM mc),
cf AS (SELECT name, mention AS canonical FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN type IS NULL OR type IN ('MISC', 'REBEL_ENTITY') THEN 0 ELSE 1 END, freq DESC, length(mention), mention) AS k FROM nm) WHERE k = 1),
fm AS (SELECT DISTINCT mention, type, canonical FROM nm JOIN cf USING (name))"""
_NAME = "regexp_replace(lower(trim(title)), '^(the|a|an|la|el|los|las)[ \\t\\n\\r\\f]+', '')"

SQL = {
    "triplet_filter": """SELECT id, unit FROM (SELECT id, unit, row_number() OVER (PARTITION BY unit, lower(trim(source_title)), lower(trim(target_title)) ORDER BY human_readable_id, id) AS k
        FROM (SELECT *, coalesce(text_unit_ids[1], '') AS unit FROM relationships) WHERE length(trim(source_title)) >= 2 AND length(trim(target_title)) >= 2 AND lower(trim(source_title)) <> lower(trim(target_title))) WHERE k = 1""",
    "complete_triplets": "SELECT id, source_title = target_title AS same_raw, upper(trim(source_title)) = upper(trim(target_title)) AS same_upper FROM relationships WHERE source_title IS NOT NULL AND target_title IS NOT NULL AND relation_type IS NOT NULL",
    "relation_validity": "SELECT id, least(1.0::DOUBLE, greatest(0.1::DOUBLE, coalesce(weight, 0.1))) AS weight FROM relationships WHERE trim(source_title) <> '' AND trim(target_title) <> '' AND trim(relation_type) <> '' AND trim(source_title) <> trim(target_title)",
    "entity_frequency": f"WITH {_M} SELECT title, count(*) AS frequency FROM m GROUP BY title",
    "entity_first_wins": f"WITH {_M} SELECT title, frequency, relation_type, description FROM (SELECT *, count(*) OVER (PARTITION BY title) AS frequency, row_number() OVER (PARTITION BY title ORDER BY human_readable_id, side) AS k FROM m) WHERE k = 1",
    "entity_chunks": f"WITH {_M} SELECT title, list_sort(list(DISTINCT unit)) AS units FROM (SELECT title, unnest(text_unit_ids) AS unit FROM m) GROUP BY title",
    "entity_degree": f"WITH {_M} SELECT title, count(*) AS degree FROM m GROUP BY title",
    "combined_degree": f"WITH {_DEG} SELECT id, combined_degree FROM cd",
    "stale_degrees": f"WITH {_DEG} SELECT id, stored, combined_degree FROM cd WHERE stored IS DISTINCT FROM combined_degree",
    "chunk_inverted_index": """WITH e AS (SELECT unit, list_sort(list(DISTINCT id)) AS entity_ids FROM (SELECT id, unnest(text_unit_ids) AS unit FROM entities) GROUP BY unit), r AS (SELECT unit, list_sort(list(DISTINCT id)) AS relationship_ids FROM (SELECT id, unnest(text_unit_ids) AS unit FROM relationships) GROUP BY unit)
        SELECT unit, coalesce(entity_ids, []) AS entity_ids, coalesce(relationship_ids, []) AS relationship_ids FROM e FULL JOIN r USING (unit)""",
    "has_entity": "SELECT DISTINCT id AS entity_id, unnest(text_unit_ids) AS unit FROM entities",
    "part_of": """WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
        p AS (SELECT doc_id, w, unnest(range(0, CAST(greatest(0, ceil((len(w) - 400) / 393.0)) AS BIGINT) + 1)) AS pos FROM t WHERE len(w) > 0) SELECT DISTINCT sha256(array_to_string(w[pos * 393 + 1 : pos * 393 + 400], ' ')) AS chunk_id, doc_id FROM p""",
    "related": """WITH k AS (SELECT * FROM (SELECT id, upper(trim(title)) AS title, row_number() OVER (PARTITION BY upper(trim(title)) ORDER BY human_readable_id, id) AS n FROM entities) WHERE n = 1)
        SELECT r.id, a.id AS source_id, b.id AS target_id FROM relationships r JOIN k a ON a.title = upper(trim(source_title)) JOIN k b ON b.title = upper(trim(target_title))""",
    "dangling_relations": "SELECT id FROM relationships WHERE source_title IS NULL OR target_title IS NULL OR upper(trim(source_title)) NOT IN (SELECT upper(trim(title)) FROM entities) OR upper(trim(target_title)) NOT IN (SELECT upper(trim(title)) FROM entities)",
    "relation_kinds": r"SELECT regexp_replace(lower(trim(relation_type)), '[\s\-]+', '_', 'g') AS kind, count(*) AS n, round(avg(weight), 6) AS mean_weight FROM relationships GROUP BY 1",
    "mention_groups": f"WITH {_TRI} SELECT mention, type, freq FROM mc",
    "mention_pairs": f"WITH n AS (SELECT DISTINCT {_NAME} AS n FROM entities) SELECT a.n AS a, b.n AS b, CAST(levenshtein(a.n, b.n) AS INTEGER) AS distance FROM n a JOIN n b ON a.n < b.n WHERE 100 * levenshtein(a.n, b.n) <= 15 * greatest(length(a.n), length(b.n))",
    "canonical_form": f"WITH {_TRI} SELECT name, canonical FROM cf",
    "apply_canonical": f"""WITH {_TRI}, o AS (SELECT t.id, coalesce(a.canonical, t.head) AS head, coalesce(b.canonical, t.tail) AS tail FROM t LEFT JOIN fm a ON a.mention = t.head AND a.type IS NOT DISTINCT FROM t.head_type LEFT JOIN fm b ON b.mention = t.tail AND b.type IS NOT DISTINCT FROM t.tail_type)
        SELECT * FROM o WHERE head IS NULL OR tail IS NULL OR head <> tail""",
}

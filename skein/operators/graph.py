"""From triplets to entities, relationships and the edges between tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.retrieval import first_wins, top_per_group
from skein.providers import EMPTY


def title_of(name: Column) -> Column:
    """The form under which names meet: trimmed, upper case."""
    return F.upper(F.trim(name))


def filter_triplets(triplets: DataFrame, scope: list[str], order: list[str], head: str = "head", tail: str = "tail", min_length: int = 2) -> DataFrame:
    """Triplets with two named ends that differ whatever their case; of a repeated pair in a scope the first stays."""
    h, t = F.trim(F.col(head)), F.trim(F.col(tail))
    good = triplets.where((F.length(h) >= min_length) & (F.length(t) >= min_length) & (F.lower(h) != F.lower(t)))
    keyed = good.withColumns({"_h": F.lower(h), "_t": F.lower(t)})
    return first_wins(keyed, [*scope, "_h", "_t"], [F.col(c) for c in order]).select(*triplets.columns)


def valid_relations(relations: DataFrame, source: str, target: str, label: str, weight: str) -> DataFrame:
    """Relations with two different named ends and a label; the weight is kept within 0.1 and 1, a missing one is 0.1."""
    s, t = F.trim(F.col(source)), F.trim(F.col(target))
    kept = relations.where((s != "") & (t != "") & (F.trim(F.col(label)) != "") & (s != t))
    return kept.withColumn(weight, F.least(F.lit(1.0), F.greatest(F.lit(0.1), F.coalesce(weight, F.lit(0.1)))))


def mentions(relations: DataFrame, source: str, target: str, *more: str) -> DataFrame:
    """One row for each end that is named: title, side (0 head, 1 tail) and the further columns."""
    ends = F.array(F.struct(title_of(F.col(source)).alias("title"), F.lit(0).alias("side")), F.struct(title_of(F.col(target)).alias("title"), F.lit(1).alias("side")))
    return relations.select(F.inline(ends), *more).where(F.length("title") > 0)


def entity_attributes(relations: DataFrame, source: str, target: str, order: str, *attributes: str) -> DataFrame:
    """title, frequency and the attributes of the first mention, heads before tails of one relation."""
    found = mentions(relations, source, target, order, *attributes)
    grouped = found.groupBy("title").agg(F.count(F.lit(1)).alias("frequency"), F.min_by(F.struct(*attributes), F.struct(order, "side")).alias("_a"))
    return grouped.select("title", "frequency", *(F.col(f"_a.{a}").alias(a) for a in attributes))


def degrees(relations: DataFrame, source: str, target: str) -> DataFrame:
    """title, degree: how often it is an end of a relation; repeated relations count each time."""
    return mentions(relations, source, target).groupBy("title").agg(F.count(F.lit(1)).alias("degree"))


def combined_degrees(relations: DataFrame, key: str, source: str, target: str) -> DataFrame:
    """key, combined_degree: the degrees of both ends added; an end without name adds 0."""
    known = degrees(relations, source, target)
    ends = relations.select(key, title_of(F.col(source)).alias("s"), title_of(F.col(target)).alias("t"))
    left = known.select(F.col("title").alias("s"), F.col("degree").alias("ds"))
    right = known.select(F.col("title").alias("t"), F.col("degree").alias("dt"))
    return ends.join(left, "s", "left").join(right, "t", "left").select(key, (F.coalesce("ds", F.lit(0)) + F.coalesce("dt", F.lit(0))).alias("combined_degree"))


def inverted_index(rows: DataFrame, key: str, units: str, name: str) -> DataFrame:
    """unit, name: the sorted keys of the rows that list each text unit."""
    return rows.select(F.explode(F.array_distinct(units)).alias("unit"), key).groupBy("unit").agg(F.array_sort(F.collect_set(key)).alias(name))


def related_edges(relations: DataFrame, entities: DataFrame, source: str = "source_title", target: str = "target_title") -> DataFrame:
    """id, source_id, target_id, relation_type, weight, description: relations whose ends are both known; others vanish."""
    known = first_wins(entities.select(title_of(F.col("title")).alias("title"), "id", "human_readable_id"), ["title"], [F.col("human_readable_id"), F.col("id")])
    left = known.select(F.col("title").alias("_s"), F.col("id").alias("source_id"))
    right = known.select(F.col("title").alias("_t"), F.col("id").alias("target_id"))
    ends = relations.withColumns({"_s": title_of(F.col(source)), "_t": title_of(F.col(target))})
    return ends.join(left, "_s").join(right, "_t").select("id", "source_id", "target_id", "relation_type", "weight", "description")


def dangling(relations: DataFrame, entities: DataFrame, source: str = "source_title", target: str = "target_title") -> DataFrame:
    """The quarantine: id of each relation with an end that no entity has; null ends are dangling too."""
    known = entities.select(title_of(F.col("title")).alias("title")).distinct()
    ends = relations.select("id", F.explode(F.array(title_of(F.col(source)), title_of(F.col(target)))).alias("title"))
    return ends.join(known, "title", "left_anti").select("id").distinct()


def undirected(edges: DataFrame, source: str = "source_id", target: str = "target_id") -> DataFrame:
    """Distinct src, dst in both directions without self loops."""
    ways = F.array(F.struct(F.col(source).alias("src"), F.col(target).alias("dst")), F.struct(F.col(target).alias("src"), F.col(source).alias("dst")))
    return edges.select(F.inline(ways)).where("src <> dst").distinct()


def in_community(communities: DataFrame, key: str = "community", entities: str = "entity_ids") -> DataFrame:
    """entity_id, community_id: the edges of communities that list their entities, each once."""
    return communities.select(F.explode(entities).alias("entity_id"), F.col(key).alias("community_id")).distinct()


def community_texts(communities: DataFrame, members: DataFrame, entities: DataFrame, names: int = 5) -> DataFrame:
    """community, text: what is embedded of a community: title, summary, and titles and descriptions of its first entities.

    ``communities`` has community, title, summary; ``members`` community, node; ``entities`` id, title, description, degree.
    The first are those of highest degree, then by title. Missing parts are left out; with nothing left it is the stand-in.
    """
    inside = members.join(entities.select(F.col("id").alias("node"), F.col("title").alias("_t"), F.col("description").alias("_d"), "degree"), "node")
    best = top_per_group(inside, ["community"], [F.desc_nulls_last("degree"), F.col("_t"), F.col("node")], names)
    parts = best.groupBy("community").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_t", "_d"))), lambda x: F.array(x["_t"], x["_d"]))).alias("_n"))
    joined = communities.select("community", "title", "summary").join(parts, "community", "left")
    filled = F.filter(F.concat(F.array("title", "summary"), F.coalesce("_n", F.array().cast("array<string>"))), lambda x: F.length(x) > 0)
    text = F.trim(F.array_join(filled, " "))
    return joined.select("community", F.when(text == "", EMPTY["community"]).otherwise(text).alias("text"))


def entity_texts(entities: DataFrame) -> DataFrame:
    """id, text: title and description; the stand-in without both."""
    text = F.trim(F.concat_ws(" ", "title", "description"))
    return entities.select("id", F.when(text == "", EMPTY["entity"]).otherwise(text).alias("text"))


def chunk_documents(chunks: DataFrame, part_of: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with the title of their document as ``document_title``; null without one."""
    titles = documents.select(F.col("id").alias("document_id"), F.col("title").alias("document_title"))
    return chunks.join(part_of.select("chunk_id", "document_id"), "chunk_id", "left").join(titles, "document_id", "left")


def community_entities(members: DataFrame, wanted: DataFrame) -> DataFrame:
    """community, node: the entities of the wanted communities, as rows, so that no community has to fit one."""
    return members.join(wanted.select("community").distinct(), "community", "left_semi").select("community", "node").distinct()


def titled_by_report(communities: DataFrame, reports: DataFrame) -> DataFrame:
    """Communities with the title of their report where there is one."""
    fresh = reports.select("community", F.col("title").alias("_title"))
    return communities.join(fresh, "community", "left").withColumn("title", F.coalesce("_title", "title")).select(*communities.columns)

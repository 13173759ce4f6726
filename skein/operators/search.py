"""Local, drift and global search over a graph's tables, as compositions of the smaller operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import vectors as V
from skein.operators import communities, context, traversal
from skein.operators.retrieval import boosted, first_wins, top_per_group
from skein.providers import Timer
from skein.session import checkpoint, written


@dataclass(frozen=True)
class Graph:
    """The tables of one graph.

    entities: id, title, entity_type, description, degree, embedding. relations: id, source_id, target_id,
    relation_type, description, weight. chunks: chunk_id, title, text, n_tokens, embedding. has_entity: chunk_id,
    entity_id. communities: community, level, rank, embedding. members: community, node (an entity id).
    """

    entities: DataFrame
    relations: DataFrame
    chunks: DataFrame
    has_entity: DataFrame
    communities: DataFrame
    members: DataFrame

    def ways(self, kinds: list[str] | None = None) -> DataFrame:
        """src, dst in both directions, of the given types of relations or of all; written once, as every hop reads it."""
        kept = self.relations if kinds is None else self.relations.where(F.col("relation_type").isin(kinds))
        both = F.array(F.struct(F.col("source_id").alias("src"), F.col("target_id").alias("dst")), F.struct(F.col("target_id").alias("src"), F.col("source_id").alias("dst")))
        return written(kept.select(F.inline(both)).where("src <> dst").distinct())


@dataclass(frozen=True)
class LocalParams:
    seeds: int = 8
    hops: int = 4
    related: int = 20
    chunks: int = 7
    candidates: int = 8


@dataclass(frozen=True)
class DriftParams:
    per_community: int = 10
    seeds: int = 15
    depth: int = 12
    chunks: int = 30
    communities: int = 30
    min_similarity: float = 0.35


@dataclass(frozen=True)
class GlobalParams:
    communities: int = 1200
    per_entity: int = 3
    snippets: int = 15
    relations: int = 5


def _vector(query: list[float]):
    return F.array(*map(F.lit, map(float, query)))


def entities_by_vector(graph: Graph, query: list[float], k: int, threshold: float) -> DataFrame:
    """id, score: the ``k`` entities above the threshold on the (1 + cosine) / 2 scale; entities without text are skipped."""
    scored = graph.entities.where("embedding IS NOT NULL AND description IS NOT NULL").select("id", V.cosine01(F.col("embedding"), _vector(query)).alias("score"))
    return scored.where(F.col("score") > threshold).orderBy(F.desc("score"), "id").limit(k)


def entities_by_names(graph: Graph, names: DataFrame, k: int) -> DataFrame:
    """id, degree of the entities with one of the lower-case names, by degree over all edges."""
    found = graph.entities.join(names, F.lower("title") == F.col("name"), "left_semi").select("id")
    ends = graph.relations.select(F.explode(F.array("source_id", "target_id")).alias("id")).unionByName(graph.has_entity.select(F.col("entity_id").alias("id"))).unionByName(graph.members.select(F.col("node").alias("id")))
    degree = ends.join(found, "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return found.join(degree, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree")).orderBy(F.desc("degree"), "id").limit(k)


def merge_seeds(by_vector: DataFrame, by_name: DataFrame, k: int) -> DataFrame:
    """id, degree, source: vector hits first, sources joined by ``+``, the greater degree; the ``k`` of highest degree."""
    both = by_vector.select("id", F.lit(0).alias("degree"), F.lit(0).alias("o"), F.lit("vector").alias("s")).unionByName(by_name.select("id", F.col("degree").cast("int"), F.lit(1).alias("o"), F.lit("llm_name").alias("s")))
    merged = both.groupBy("id").agg(F.max("degree").alias("degree"), F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("o", "s"))), lambda x: x["s"]), "+").alias("source"))
    return merged.orderBy(F.desc("degree"), "id").limit(k)


def relations_between(graph: Graph, seeds: DataFrame, everyone: DataFrame) -> DataFrame:
    """Directed relations from a seed to any of the entities in view."""
    a, b = seeds.select(F.col("id").alias("source_id")), everyone.select(F.col("id").alias("target_id"))
    return graph.relations.join(a, "source_id", "left_semi").join(b, "target_id", "left_semi")


def entity_chunks(graph: Graph, entities: DataFrame, query: list[float], k: int) -> DataFrame:
    """entity_id, chunk_id, text, relevance, rank: the ``k`` most similar chunks of each entity."""
    met = graph.has_entity.join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").distinct().join(graph.chunks, "chunk_id")
    scored = met.select("entity_id", "chunk_id", "text", F.coalesce(V.cosine01(F.col("embedding"), _vector(query)), F.lit(0.0)).alias("relevance"))
    return top_per_group(scored, ["entity_id"], [F.desc("relevance"), F.col("chunk_id")], k)


def local_search(graph: Graph, query: list[float], names: DataFrame, params: LocalParams = LocalParams()) -> DataFrame:
    """One row: context, approx_token_count, from seeds, their neighbourhood, relations and reranked chunks."""
    seeds = checkpoint(merge_seeds(entities_by_vector(graph, query, params.candidates, 0.6), entities_by_names(graph, names, params.candidates), params.seeds))
    around = checkpoint(traversal.hops(graph.ways(), seeds.select(F.col("id").alias("node")), params.hops, params.related))
    everyone = seeds.select("id").union(around.select("node"))
    links = relations_between(graph, seeds, everyone)
    scored = graph.chunks.where("embedding IS NOT NULL").withColumn("score", V.cosine01(F.col("embedding"), _vector(query)))
    near = scored.where("score > 0.2").orderBy(F.desc("score"), "chunk_id").limit(2 * params.chunks).select("chunk_id", F.lit(0).alias("o"))
    own = graph.has_entity.join(seeds.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").join(graph.chunks.select("chunk_id", "n_tokens"), "chunk_id")
    short = top_per_group(own, ["entity_id"], [F.col("n_tokens"), F.col("chunk_id")], 2 * params.chunks).select("chunk_id", F.lit(1).alias("o"))
    picked = first_wins(near.unionByName(short), ["chunk_id"], [F.col("o")])
    best = graph.chunks.join(picked, "chunk_id").withColumn("score", V.cosine(F.col("embedding"), _vector(query))).orderBy(F.desc_nulls_last("score"), "chunk_id").limit(params.chunks)
    named = graph.entities.select("id", "title", "entity_type", "description", "degree")
    label = F.concat(F.lit("## "), "title", F.lit(" ("), F.coalesce("entity_type", F.lit("Unknown")), F.lit(")\n"), F.coalesce("description", F.lit("No description available")))
    s, t = named.select(F.col("id").alias("source_id"), F.col("title").alias("s")), named.select(F.col("id").alias("target_id"), F.col("title").alias("t"))
    link = F.concat(F.lit("- "), "s", F.lit(" → "), F.coalesce("description", F.lit("related to")), F.lit(" → "), "t", F.format_string(" (strength: %.1f)", F.coalesce("weight", F.lit(1.0))))
    rest = named.join(around.select(F.col("node").alias("id"), "hop"), "id").join(seeds.select("id"), "id", "left_anti")
    more = F.concat(F.lit("- **"), "title", F.lit("** ("), F.coalesce("entity_type", F.lit("Unknown")), F.lit(")"), F.when(F.length("description") > 0, F.concat(F.lit(": "), "description")).otherwise(""))
    return context.sections([
        ("# Relevant Information from Source Documents", best.select((-F.round(1e6 * F.coalesce("score", F.lit(-2.0)))).alias("ord"), F.concat(F.lit("## From: "), F.coalesce("title", F.lit("Source document")), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("line"))),
        ("# Key Entities", named.join(seeds.select("id"), "id").select((-F.coalesce("degree", F.lit(0))).alias("ord"), label.alias("line"))),
        ("# Key Relationships", links.drop("title").join(s, "source_id").join(t, "target_id").select((-F.round(1e6 * F.coalesce("weight", F.lit(0.0)))).alias("ord"), link.alias("line"))),
        ("# Related Entities", rest.select(F.col("hop").alias("ord"), more.alias("line"))),
    ])


def community_candidates(graph: Graph, query: list[float], names: DataFrame, level: int | list[int], limit: int = 30, min_similarity: float = 0.2) -> DataFrame:
    """community, rank, source, relevance: communities with a named entity (score 1) first, then by vector.

    Of one level or several. Communities without a summary are skipped where there is that column. Twice as many are taken
    by name as there are names, which are the few of one question.
    """
    rows = graph.communities.where(F.col("level").isin(level if isinstance(level, list) else [level]))
    if "summary" in rows.columns:
        rows = rows.where("summary IS NOT NULL")
    most = 2 * names.count()
    scored = rows.where("embedding IS NOT NULL").select("community", V.cosine01(F.col("embedding"), _vector(query)).alias("vector_score")).where(F.col("vector_score") >= min_similarity).orderBy(F.desc("vector_score"), "community").limit(limit * limit)
    met = graph.entities.join(names, F.lower("title") == F.col("name"), "left_semi").select(F.col("id").alias("node"))
    held = graph.members.join(met, "node", "left_semi").select("community").distinct().join(rows.select("community", "rank"), "community").orderBy(F.desc("rank"), "community").limit(most).select("community", F.lit("entity").alias("_e"))
    both = held.join(scored, "community", "full").join(rows.select("community", "rank"), "community")
    found = both.select("community", "rank", F.coalesce("_e", F.lit("vector")).alias("source"), F.when(F.col("_e").isNotNull(), 1.0).otherwise(F.col("vector_score")).alias("relevance"))
    return found.orderBy(F.desc("relevance"), "community").limit(limit)


def community_relevance(candidates: DataFrame, members: DataFrame, weights: DataFrame, drift: bool = True) -> DataFrame:
    """community, score: weighted sum of semantic score (0 if missing), the weights of its query entities, and its rank."""
    entity = members.join(weights, "node").groupBy("community").agg(F.sum("weight").alias("entity_score"))
    a, b, c = (0.1, 0.7, 0.2) if drift else (0.5, 0.2, 0.2)
    semantic = F.coalesce("semantic", F.lit(0.0)) if "semantic" in candidates.columns else F.lit(0.0)
    return candidates.join(entity, "community", "left").select("community", (a * semantic + b * F.coalesce("entity_score", F.lit(0.0)) + c * F.coalesce("rank", F.lit(0.0))).alias("score"))


def drift_search(graph: Graph, query: list[float], names: DataFrame, params: DriftParams = DriftParams()) -> DataFrame:
    """One row: context, approx_token_count. Seeds come from the best communities, weighted entities first, in the order
    of community score, weight and id; then entities found directly."""
    found = checkpoint(community_candidates(graph, query, names, 0, params.communities, params.min_similarity))
    weights = checkpoint(entities_by_vector(graph, query, params.seeds, 0.7).select(F.col("id").alias("node"), F.col("score").alias("weight")))
    inside = graph.members.join(found.select("community"), "community", "left_semi")
    ranked = community_relevance(found, inside, weights)
    placed = inside.join(weights, "node", "left").withColumn("weighted", F.col("weight").isNotNull().cast("int"))
    chosen = top_per_group(placed, ["community", "weighted"], [F.desc_nulls_last("weight"), F.col("node")], params.per_community)
    direct = entities_by_vector(graph, query, params.seeds // 2, 0.6).select("id").unionByName(entities_by_names(graph, names, params.seeds).select("id"))
    ordered = chosen.join(ranked, "community").select("node", (-F.col("score")).alias("a"), (-F.col("weighted")).alias("b"), (-F.coalesce("weight", F.lit(0.0))).alias("c")).unionByName(direct.select(F.col("id").alias("node"), F.lit(0.0).alias("a"), F.lit(0).alias("b"), F.lit(0.0).alias("c")))
    seeds = checkpoint(first_wins(ordered, ["node"], [F.col("a"), F.col("b"), F.col("c")]).orderBy("a", "b", "c", "node").limit(params.seeds).select("node"))
    around = checkpoint(traversal.hops(graph.ways(), seeds, params.depth, 2 * params.seeds).select("node"))
    focus = seeds.withColumn("is_seed", F.lit(True)).unionByName(around.withColumn("is_seed", F.lit(False)))
    texts = entity_chunks(graph, focus.select(F.col("node").alias("id")), query, 2).join(focus.withColumnRenamed("node", "entity_id"), "entity_id")
    best = checkpoint(boosted(texts.select("entity_id", "chunk_id", "text", "relevance", "is_seed"), k=params.chunks))
    names_of = graph.entities.select(F.col("id").alias("entity_id"), F.col("title").alias("entity"))
    order = (-F.round(1e6 * F.col("score"))).alias("ord")
    lines = best.join(names_of, "entity_id")
    heads = lines.groupBy("entity_id", "entity").agg(F.max("score").alias("score"))
    united = heads.select((1 - F.round(1e6 * F.col("score"))).alias("o"), F.format_string("### Context related to: %s (Top Chunk Score: %.3f)", F.col("entity"), F.col("score")).alias("line"), "entity_id", F.lit(0).alias("p"))
    body = lines.select(order.alias("o"), F.regexp_replace("text", r"\n\s*\n", "\n").alias("line"), "entity_id", F.lit(1).alias("p"))
    top = heads.select("entity_id", (-F.round(1e6 * F.col("score"))).alias("h"))
    return context.sections([("## Detailed Evidence from Sources", united.unionByName(body).join(top, "entity_id").select((F.col("h") * 4 + F.col("p")).alias("ord"), "line"))])


def global_search(graph: Graph, query: list[float], params: GlobalParams = GlobalParams()) -> DataFrame:
    """One row: context, approx_token_count: the best snippets of the most similar communities and the links between them."""
    scored = graph.communities.select("community", F.coalesce(V.cosine(F.col("embedding"), _vector(query)), F.lit(0.0)).alias("similarity"))
    top = checkpoint(scored.orderBy(F.desc("similarity"), "community").limit(params.communities))
    inside = graph.members.join(top, "community")
    texts = entity_chunks(graph, inside.select(F.col("node").alias("id")).distinct(), query, params.per_entity)
    one = first_wins(texts.drop("rank"), ["chunk_id"], [-F.col("relevance"), F.col("entity_id")]).where("relevance > 0.1")
    best = one.orderBy(F.desc("relevance"), "chunk_id").limit(params.snippets)
    distinct = first_wins(best, ["text"], [-F.col("relevance"), F.col("chunk_id")]).join(graph.entities.select(F.col("id").alias("entity_id"), F.col("title").alias("entity")), "entity_id", "left")
    snippet = F.concat(F.format_string("### Snippet (LLM Relevance: %.2f, Related to: %s)\n", F.col("relevance"), F.coalesce("entity", F.lit("Source Document"))), F.coalesce("text", F.lit("")))
    position = inside.select("node", "community", (-F.col("similarity")).alias("position"))
    cross = communities.cross_community(graph.relations, position, params.relations).join(graph.relations.select("id", "description", "relation_type"), "id")
    names = graph.entities.select("id", "title")
    s, t = names.select(F.col("id").alias("source_id"), F.col("title").alias("s")), names.select(F.col("id").alias("target_id"), F.col("title").alias("t"))
    kind = F.lower(F.replace(F.regexp_replace(F.coalesce("relation_type", F.lit("RELATED")), "^(DL|LLM)_", ""), F.lit("_"), F.lit(" ")))
    link = F.concat(F.lit("- **"), "s", F.lit("** --["), F.when(F.length("description") > 0, F.col("description")).otherwise(kind), F.lit("]--> **"), "t", F.lit("**"))
    return context.sections([
        ("## Detailed Supporting Information (Snippets Ranked by Relevance to Query)", distinct.select((-F.round(1e6 * F.col("relevance"))).alias("ord"), snippet.alias("line"))),
        ("## Connections Between Identified Themes", cross.join(s, "source_id").join(t, "target_id").select((-F.round(1e6 * F.coalesce("weight", F.lit(0.0)))).alias("ord"), link.alias("line"))),
    ])


def expand(graph: Graph, seeds: DataFrame, depth: int = 12, limit: int = 30, kinds: list[str] | None = None) -> DataFrame:
    """node, hop: entities within ``depth`` relations of any seed, each once; only entities of the graph are walked on."""
    known = graph.entities.select(F.col("id").alias("dst"))
    return traversal.hops(graph.ways(kinds).join(known, "dst", "left_semi"), seeds, depth, limit)


def graph_search(graph: Graph, query: list[float], names: DataFrame) -> DataFrame:
    """strategy, context, approx_token_count, time_taken, error: the three searches of one graph.

    Each search is run and timed on its own; one that fails gives its error and no context.
    """
    spark = graph.entities.sparkSession
    rows = []
    for name, run in (("global", lambda: global_search(graph, query)), ("local", lambda: local_search(graph, query, names)), ("drift", lambda: drift_search(graph, query, names))):
        text, tokens, error = None, 0, None
        with Timer() as timer:
            try:
                text, tokens = run().select("context", "approx_token_count").first()  # one row
            except Exception as failed:  # a failed search leaves the others alone
                error = f"{type(failed).__name__}: {failed}"[:2000]
        rows.append((name, text, tokens, timer.seconds, error))
    return spark.createDataFrame(rows, "strategy string, context string, approx_token_count int, time_taken double, error string")

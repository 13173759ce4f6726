"""Queries over edges and texts of a graph's tables, collections, sinks, casts and maps, and the parts of the searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions import values
from skein.operators import chunking, graph, qa, search, traversal, triplets
from skein.operators.communities import hierarchy
from skein.plans.community_queries import _E, _edges
from skein.plans.community_queries import SQL as _GRAPH_SQL
from skein.plans.search_queries import _G, _graph, _names
from skein.plans.tables import table
from skein.providers import HashEmbedder, embed_rows
from skein.session import checkpoint_path
from skein.sources import crawl, store
from skein.sources.collections import Collections


def _letters(spark: SparkSession, folder: str) -> DataFrame:
    """First letters as communities: community, title, summary."""
    return table(spark, folder, "entities").select(F.substring("title", 1, 1).alias("community")).distinct().select("community", F.concat(F.lit("Letter "), "community").alias("title"), F.lit(None).cast("string").alias("summary"))


def _members(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "entities").select(F.substring("title", 1, 1).alias("community"), F.col("id").alias("node"))


def in_community(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of the communities that share a type, from their lists of entities."""
    lists = table(spark, folder, "entities").groupBy("entity_type", F.pmod("human_readable_id", F.lit(50)).alias("part")).agg(F.collect_list("id").alias("entity_ids"))
    return graph.in_community(lists.select(F.concat_ws("-", F.coalesce("entity_type", F.lit("none")), "part").alias("community"), "entity_ids"))


def community_texts(spark: SparkSession, folder: str) -> DataFrame:
    return graph.community_texts(_letters(spark, folder), _members(spark, folder), table(spark, folder, "entities"))


def entity_texts(spark: SparkSession, folder: str) -> DataFrame:
    return graph.entity_texts(table(spark, folder, "entities"))


def community_entities(spark: SparkSession, folder: str) -> DataFrame:
    return graph.community_entities(_members(spark, folder), _letters(spark, folder).where("community < 'H'"))


def chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of every document, and the title of those whose document has an even number."""
    documents = table(spark, folder, "documents")
    chunks = chunking.token_windows(documents, "doc_id", "text").select(F.concat_ws("-", "doc_id", "pos").alias("chunk_id"), "doc_id")
    edges = chunks.where("doc_id % 2 = 0").select("chunk_id", F.col("doc_id").alias("document_id"))
    return graph.chunk_documents(chunks.select("chunk_id"), edges, documents.select(F.col("doc_id").alias("id"), "title")).select("chunk_id", "document_title")


def report_titles(spark: SparkSession, folder: str) -> DataFrame:
    found = _letters(spark, folder).where("community < 'H'").select("community", F.concat(F.lit("Report on "), "community").alias("title"))
    return graph.titled_by_report(_letters(spark, folder), found).select("community", "title")


def _uploaded(spark: SparkSession, folder: str) -> Collections:
    documents = table(spark, folder, "documents")
    kept = Collections(spark, f"{checkpoint_path(documents)}/collections-{abs(hash(folder))}")
    kept.create()
    kept.upload(documents, HashEmbedder(32))
    return kept


def vector_collections(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and terms of the three collections after an upload of all documents."""
    kept, out = _uploaded(spark, folder), None
    for name in ("dense", "sparse", "hybrid"):
        rows = spark.read.parquet(f"{kept.folder}/{name}")
        terms = F.sum(F.size("weights")) if "weights" in rows.columns else F.lit(None).cast("bigint")
        part = rows.agg(F.count(F.lit(1)).alias("documents"), terms.alias("terms")).withColumn("collection", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def collection_search(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse search in the collection, asked by every document with a number divisible by 20, and in one that is unknown."""
    kept = _uploaded(spark, folder)
    asked = table(spark, folder, "documents").where("doc_id % 20 = 0 AND text IS NOT NULL")
    return kept.search("sparse", asked, HashEmbedder(32)).unionByName(kept.search("nowhere", asked, HashEmbedder(32))).select("query_id", "doc_id", F.round("score", 6).alias("score"))


def graph_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """All statistics of the graph; communities are the first one to three letters of the titles, which SQL can say too."""
    entities = table(spark, folder, "entities")
    levels = entities.select(F.col("human_readable_id").alias("node"), F.posexplode(F.array(*(F.substring("title", 1, k) for k in (1, 2, 3)))).alias("level", "community"))
    found = traversal.graph_statistics(_edges(spark, folder), "Classical", entities.select(F.col("human_readable_id").alias("node")), levels)
    path = f"{checkpoint_path(found)}/statistics-{abs(hash(folder))}.json"
    store.write_statistics(found, path)
    kinds = {f.name: f.dataType for f in found.schema.fields}
    return spark.read.json(path).select(*(F.col(c).cast(kinds[c]).alias(c) for c in store.STATISTICS))


def metric_views(spark: SparkSession, folder: str) -> DataFrame:
    views = store.metric_views(table(spark, folder, "metric_records"), ["relevancy", "recall"])
    return views["metrics_by_day"].select("search_type", F.col("day").cast("date").alias("day"), "records", "relevancy", "recall")


def metric_fallbacks(spark: SparkSession, folder: str) -> DataFrame:
    return store.metric_views(table(spark, folder, "metric_records"), ["relevancy"])["metric_fallbacks"]


def stored_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Relations written to the graph store twice, the second time with later rows of the same ids, and read back."""
    rows = table(spark, folder, "relationships").select(F.expr("CASE WHEN human_readable_id % 10 = 9 THEN NULL ELSE CAST(human_readable_id % 500 AS STRING) END").alias("id"), "relation_type", F.col("human_readable_id").alias("_sequence"))
    kept = store.GraphStore(spark, f"{checkpoint_path(rows)}/graph-{abs(hash(folder))}")
    for prefix in ("DL", "LLM"):
        kept.write(prefix, {"related": rows})
    return kept.read("DL", "related").select("id", "relation_type")


def casts(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers, truth values and starts of what stands in text columns."""
    rows = table(spark, folder, "documents")
    word = F.element_at(F.split("title", " "), -1)
    return rows.select("doc_id", values.number_or(word).alias("number"), values.whole_or(F.col("creation_date"), -1).alias("whole"), values.truth_or(F.when(F.col("doc_id") % 3 == 0, "true").otherwise(F.col("lang"))).alias("truth"), values.truncated(F.col("text"), 30).alias("start"))


def merged_maps(spark: SparkSession, folder: str) -> DataFrame:
    """Attributes of relations as two maps merged, the later value winning, and one value with a default."""
    rows = table(spark, folder, "relationships")
    first = F.create_map(F.lit("type"), "relation_type", F.lit("weight"), F.col("weight").cast("string"))
    second = F.when(F.col("human_readable_id") % 2 == 0, F.create_map(F.lit("type"), F.lit("changed"), F.lit("source"), F.col("source_title")))
    both = values.merged(first, second)
    return rows.select("id", values.value_of(both, "type").alias("kind"), values.value_of(both, "source", "none").alias("source"), values.value_of(both, "absent", "?").alias("absent"), F.size(both).alias("entries"))


def linear_triplets(spark: SparkSession, folder: str) -> DataFrame:
    """Relations written as a linear text with marks, two tails to a head, and parsed."""
    rows = table(spark, folder, "relationships").where("relation_type IS NOT NULL AND trim(source_title) <> '' AND trim(target_title) <> ''")
    line = F.concat(F.lit("<s><triplet> "), F.trim("source_title"), F.lit(" <subj> "), F.trim("target_title"), F.lit(" <obj> "), "relation_type", F.lit(" <subj> Other <obj> near </s>"))
    return triplets.parse_linear(rows.select("id", line.alias("line")), "id", "line").select("id", "t", "head", F.col("type"), "tail")


def mention_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """The type of each title among the words of its own number: its own, one with a letter more, one that is no name."""
    rows = table(spark, folder, "entities").where("length(title) > 8")
    names = rows.select(F.col("human_readable_id").alias("scope"), F.col("title").alias("name"))
    words = rows.select(F.col("human_readable_id").alias("scope"), F.posexplode(F.array(F.lit("zz"), F.concat("title", F.lit("s")), F.when(F.col("human_readable_id") % 2 == 0, F.col("title")))).alias("pos", "word")).where("word IS NOT NULL")
    found = words.withColumn("kind", F.array(F.lit("NONE"), F.lit("NEAR"), F.lit("SAME"))[F.col("pos")])
    return triplets.mention_types(names, found, "scope")


def budget_sample(spark: SparkSession, folder: str) -> DataFrame:
    """One row: whether the seeded sample of documents keeps to its budget of words and ends before the next row passes it."""
    sized = table(spark, folder, "documents").select("doc_id", "text")
    found = chunking.sample_under_budget(sized, "doc_id", "text", 20_000)
    return found.agg((F.max("running") <= 20_000).alias("within"), (F.sum("n_tokens") == F.max("running")).alias("adds_up"), (F.count(F.lit(1)) > 0).alias("filled"))


def fenced_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Titles fenced as JSON in some replies and bare in others."""
    reply = F.when(F.col("human_readable_id") % 3 > 0, F.concat(F.lit("Here:\n```json\n"), "title", F.lit("\n```\nDone."))).otherwise(F.col("title"))
    return table(spark, folder, "entities").select("id", T.fenced_json(reply).alias("body"))


def evaluation_objects(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "metric_records").select("record_id", F.col("time_taken").alias("retrieval_time"), F.lit(1.5).alias("llm_time"), "num_input_token", "num_output_token", "retrieval_context")
    return qa.evaluation_objects(rows).select("record_id", F.round("time_taken", 6).alias("time_taken"), "total_tokens", F.element_at("retrieval_context", 1).alias("context"))


def import_issues(spark: SparkSession, folder: str) -> DataFrame:
    """What keeps tables from being imported, by table."""
    rows = table(spark, folder, "entities").select("id", F.lit(None).cast("string").alias("title"), F.array(F.array("id")).alias("nested"))
    cases = {"good": rows.select("id"), "none": None, "empty": rows.select("id").limit(0), "odd": rows}
    return spark.createDataFrame([(name, issue) for name, t in cases.items() for issue in store.issues(t, ["id", "title"] if name == "odd" else ["id"])], "name string, issue string")


def json_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Structs as JSON text, other columns as they are."""
    return store.as_json_text(table(spark, folder, "entities").select("id", F.struct("x_pos", "frequency").alias("place"), "text_unit_ids")).select("id", "place", F.size("text_unit_ids").alias("units"))


def crawl_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Fetching files that are not there: every URL fails alone, with its error as a row."""
    urls = table(spark, folder, "crawl_pages").where("url IS NOT NULL").select(F.concat(F.lit("/nowhere/"), F.xxhash64("url").cast("string")).alias("url"))
    return crawl.fetch_pages(urls, crawl.FileFetcher).agg(F.count("chunk").alias("fetched"), F.count("error").alias("failed"))


def query_names(spark: SparkSession, folder: str) -> DataFrame:
    """The titles that stand in a question made of three of them, the longest first."""
    from skein.providers import names_in

    entities = table(spark, folder, "entities")
    asked = [r[0] for r in entities.where("human_readable_id IN (5, 11, 17)").select("title").collect()]
    return names_in("What links " + " and ".join(asked) + "?", entities)


def local_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Seeds of the local search: by vector and by name, the greater degree, the eight best."""
    parts, query = _graph(spark, folder)
    return search.merge_seeds(search.entities_by_vector(parts, query, 8, 0.6), search.entities_by_names(parts, _names(spark, folder), 8), 8)


def seed_relations(spark: SparkSession, folder: str) -> DataFrame:
    """Relations from entities with a number below 40 to those below 200."""
    parts, _ = _graph(spark, folder)
    ids = lambda n: parts.entities.where(F.col("human_readable_id") < n).select("id")
    return search.relations_between(parts, ids(40), ids(200)).select("id")


def ranked_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The two chunks of each entity most similar to the query."""
    parts, query = _graph(spark, folder)
    return search.entity_chunks(parts, parts.entities.select("id"), query, 2).select("entity_id", "chunk_id", F.round("relevance", 6).alias("relevance"), "rank")


def expanded(spark: SparkSession, folder: str) -> DataFrame:
    """Entities within three relations of one type from the first ten, the first 30."""
    parts, _ = _graph(spark, folder)
    seeds = parts.entities.where("human_readable_id < 10").select(F.col("id").alias("node"))
    return search.expand(parts, seeds, 3, 30, ["orbits", "part of"])


def global_communities(spark: SparkSession, folder: str) -> DataFrame:
    """Communities by raw cosine to the query, 0 without a vector."""
    from skein.functions import vectors as V

    parts, query = _graph(spark, folder)
    return parts.communities.select("community", F.round(F.coalesce(V.cosine(F.col("embedding"), F.array(*map(F.lit, map(float, query)))), F.lit(0.0)), 6).alias("similarity"))


def graph_searches(spark: SparkSession, folder: str) -> DataFrame:
    """The three searches, each with its time and its error; all give a context with as many words as they say."""
    parts, query = _graph(spark, folder)
    found = search.graph_search(parts, query, _names(spark, folder))
    words = F.size(F.filter(F.split("context", r"\s+"), lambda w: w != ""))
    return found.select("strategy", "error", (F.col("time_taken") > 0).alias("timed"), (words == F.col("approx_token_count")).alias("counted"))


def embedded_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings of all entity texts have length 1."""
    rows = embed_rows(graph.entity_texts(table(spark, folder, "entities")), "id", "text", HashEmbedder(512), "entity")
    return rows.select("id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 6).alias("square"))


def community_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """What holds of detected communities: each level covers its nodes once, and a child lies in one parent."""
    edges = _edges(spark, folder).where("src <> dst").select("src", "dst", F.lit(1.0).alias("weight"))
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    found = hierarchy(both)
    once = found.groupBy("level").agg((F.count(F.lit(1)) == F.count_distinct("node")).alias("once"))
    nested = found.groupBy("level", "community").agg(F.count_distinct("parent").alias("n")).groupBy("level").agg((F.max("n") == 1).alias("nested"))
    return once.join(nested, "level").join(found.where("level = 0").agg(F.count(F.lit(1)).alias("nodes")), how="cross")


QUERIES = {
    f.__name__: f
    for f in (in_community, community_texts, entity_texts, community_entities, chunk_documents, report_titles, vector_collections, collection_search, graph_statistics, metric_views, metric_fallbacks,
              stored_graph, casts, merged_maps, linear_triplets, mention_kinds, budget_sample, fenced_answers, evaluation_objects, import_issues, json_columns, crawl_failures, query_names, local_seeds,
              seed_relations, ranked_chunks, expanded, global_communities, graph_searches, embedded_texts, community_invariants)
}

_KNOWN = "kn AS (SELECT * FROM (SELECT id, human_readable_id AS n, upper(trim(title)) AS t, row_number() OVER (PARTITION BY upper(trim(title)) ORDER BY human_readable_id, id) AS o FROM entities) WHERE o = 1), rl AS (SELECT r.id, a.id AS sid, b.id AS tid, relation_type FROM relationships r JOIN kn a ON a.t = upper(trim(source_title)) JOIN kn b ON b.t = upper(trim(target_title)))"
_HELD = "held AS (SELECT id AS entity_id, unnest([human_readable_id, human_readable_id + 1]) AS chunk_id FROM entities)"

SQL = {
    "in_community": "SELECT id AS entity_id, coalesce(entity_type, 'none') || '-' || (human_readable_id % 50) AS community_id FROM entities",
    "community_texts": """WITH m AS (SELECT left(title, 1) AS community, title, description, row_number() OVER (PARTITION BY left(title, 1) ORDER BY degree DESC NULLS LAST, title, id) AS k FROM entities)
        SELECT community, trim('Letter ' || community || ' ' || string_agg(title || CASE WHEN length(description) > 0 THEN ' ' || description ELSE '' END, ' ' ORDER BY k)) AS text FROM m WHERE k <= 5 GROUP BY community""",
    "entity_texts": "SELECT id, CASE WHEN trim(concat_ws(' ', title, description)) = '' THEN 'Unknown entity' ELSE trim(concat_ws(' ', title, description)) END AS text FROM entities",
    "community_entities": "SELECT left(title, 1) AS community, id AS node FROM entities WHERE left(title, 1) < 'H'",
    "chunk_documents": """WITH t AS (SELECT doc_id, title, list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL)
        SELECT doc_id || '-' || pos AS chunk_id, CASE WHEN doc_id % 2 = 0 THEN title END AS document_title FROM (SELECT doc_id, title, unnest(range(0, CAST(greatest(0, ceil((len(w) - 400) / 393.0)) AS BIGINT) + 1)) AS pos FROM t WHERE len(w) > 0)""",
    "report_titles": "SELECT DISTINCT left(title, 1) AS community, CASE WHEN left(title, 1) < 'H' THEN 'Report on ' ELSE 'Letter ' END || left(title, 1) AS title FROM entities",
    "vector_collections": """WITH w AS (SELECT doc_id, len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))) AS n FROM documents)
        SELECT 'dense' AS collection, count(*) AS documents, CAST(NULL AS BIGINT) AS terms FROM w UNION ALL SELECT 'sparse', count(*), CAST(sum(n) AS BIGINT) FROM w UNION ALL SELECT 'hybrid', count(*), CAST(sum(n) AS BIGINT) FROM w""",
    "graph_statistics": f"""SELECT 'Classical' AS graph_type, number_of_nodes, number_of_relationships, mean_distance, diameter, radius, num_wcc, largest_wcc_size, num_scc, largest_scc_size,
        (SELECT count(DISTINCT left(title, 1)) FROM entities) AS communities_level_1, (SELECT count(DISTINCT left(title, 2)) FROM entities) AS communities_level_2, (SELECT count(DISTINCT left(title, 3)) FROM entities) AS communities_level_3
        FROM ({_GRAPH_SQL["graph_stats"]}), ({_GRAPH_SQL["mean_distance"]}), ({_GRAPH_SQL["ecc_diameter_radius"]}), ({_GRAPH_SQL["component_stats"]})""",
    "metric_views": "SELECT search_type, CAST(created_at AS DATE) AS day, count(*) AS records, round(avg(coalesce(relevancy, 0)), 6) AS relevancy, round(avg(coalesce(recall, 0)), 6) AS recall FROM metric_records GROUP BY ALL",
    "metric_fallbacks": "SELECT search_type, " + ", ".join(f"count(*) FILTER (WHERE {c}_{m}) AS {c}_{m}" for c in ("fallback_used_and_succeeded", "final_state_failed") for m in ("relevancy", "precision", "recall")) + " FROM metric_records GROUP BY search_type",
    "stored_graph": "SELECT id, relation_type FROM (SELECT CAST(human_readable_id % 500 AS VARCHAR) AS id, relation_type, row_number() OVER (PARTITION BY human_readable_id % 500 ORDER BY human_readable_id DESC) AS k FROM relationships WHERE human_readable_id % 10 <> 9) WHERE k = 1",
    "casts": """SELECT doc_id, coalesce(TRY_CAST(string_split(title, ' ')[-1] AS DOUBLE), 0) AS number, coalesce(TRY_CAST(CASE WHEN regexp_matches(creation_date, '^\\s*[+-]?\\d+\\s*$') THEN creation_date END AS BIGINT), -1) AS whole,
        coalesce(TRY_CAST(CASE WHEN doc_id % 3 = 0 THEN 'true' ELSE lang END AS BOOLEAN), false) AS truth, left(text, 30) AS start FROM documents""",
    "merged_maps": """SELECT id, CASE WHEN human_readable_id % 2 = 0 THEN 'changed' ELSE coalesce(relation_type, '?') END AS kind, CASE WHEN human_readable_id % 2 = 0 THEN coalesce(source_title, 'none') ELSE 'none' END AS source, '?' AS absent,
        CAST(CASE WHEN human_readable_id % 2 = 0 THEN 3 ELSE 2 END AS INTEGER) AS entries FROM relationships""",
    "linear_triplets": r"""WITH r AS (SELECT id, regexp_replace(trim(source_title), '\s+', ' ', 'g') AS head, regexp_replace(trim(target_title), '\s+', ' ', 'g') AS tail, regexp_replace(trim(relation_type), '\s+', ' ', 'g') AS type FROM relationships WHERE relation_type IS NOT NULL AND trim(source_title) <> '' AND trim(target_title) <> '')
        SELECT id, CAST(0 AS INTEGER) AS t, head, type, tail FROM r UNION ALL SELECT id, 1, head, 'near', 'Other' FROM r""",
    "mention_kinds": "SELECT human_readable_id AS scope, title AS name, CASE WHEN human_readable_id % 2 = 0 THEN 'SAME' ELSE 'NEAR' END AS type FROM entities WHERE length(title) > 8",
    "budget_sample": "SELECT true AS within, true AS adds_up, true AS filled",
    "fenced_answers": "SELECT id, CASE WHEN human_readable_id % 3 > 0 THEN trim(title) END AS body FROM entities",
    "evaluation_objects": "SELECT record_id, round(coalesce(time_taken, 0) + 1.5, 6) AS time_taken, coalesce(num_input_token, 0) + coalesce(num_output_token, 0) AS total_tokens, retrieval_context AS context FROM metric_records",
    "import_issues": "SELECT * FROM (VALUES ('none', 'no table'), ('empty', 'no rows'), ('odd', 'column title is null throughout'), ('odd', 'column nested is nested deeply')) v(name, issue)",
    "crawl_failures": "SELECT 0 AS fetched, count(DISTINCT url) AS failed FROM crawl_pages WHERE url IS NOT NULL",
    "query_names": "WITH q AS (SELECT lower('What links ' || string_agg(title, ' and ') || '?') AS q FROM entities WHERE human_readable_id IN (5, 11, 17)) SELECT name FROM (SELECT DISTINCT lower(title) AS name FROM entities, q WHERE length(title) > 1 AND contains(q, lower(title))) ORDER BY length(name) DESC, name LIMIT 6",
    "local_seeds": f"""WITH {_G}, {_KNOWN}, {_HELD}, v AS (SELECT id FROM w WHERE weight > 0.6 ORDER BY weight DESC, id LIMIT 8), f AS (SELECT id FROM entities WHERE lower(title) IN (SELECT lower(title) FROM entities WHERE human_readable_id < 3)),
        d AS (SELECT id, count(*) AS degree FROM (SELECT sid AS id FROM rl UNION ALL SELECT tid FROM rl UNION ALL SELECT entity_id FROM held UNION ALL SELECT id FROM entities) GROUP BY id), n AS (SELECT id, coalesce(degree, 0) AS degree FROM f LEFT JOIN d USING (id) ORDER BY degree DESC, id LIMIT 8)
        SELECT id, CAST(max(degree) AS INTEGER) AS degree, string_agg(s, '+' ORDER BY o) AS source FROM (SELECT id, 0 AS degree, 0 AS o, 'vector' AS s FROM v UNION ALL SELECT id, degree, 1, 'llm_name' FROM n) GROUP BY id ORDER BY degree DESC, id LIMIT 8""",
    "seed_relations": f"WITH {_KNOWN} SELECT rl.id FROM rl JOIN entities a ON a.id = sid JOIN entities b ON b.id = tid WHERE a.human_readable_id < 40 AND b.human_readable_id < 200",
    "ranked_chunks": f"""WITH {_HELD}, q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT DISTINCT entity_id, CAST(doc_id AS VARCHAR) AS chunk_id, coalesce((1 + list_cosine_similarity(CAST(embedding AS DOUBLE[]), q)) / 2, 0) AS relevance FROM held JOIN documents ON doc_id = chunk_id LEFT JOIN embeddings ON vec_id = doc_id, q)
        SELECT entity_id, chunk_id, round(relevance, 6) AS relevance, rank FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY relevance DESC, chunk_id) AS rank FROM s) WHERE rank <= 2""",
    "expanded": f"""WITH RECURSIVE {_KNOWN}, u AS (SELECT DISTINCT * FROM (SELECT sid AS src, tid AS dst FROM rl WHERE relation_type IN ('orbits', 'part of') UNION ALL SELECT tid, sid FROM rl WHERE relation_type IN ('orbits', 'part of')) WHERE src <> dst),
        h AS (SELECT id AS node, 0 AS hop FROM entities WHERE human_readable_id < 10 UNION SELECT u.dst, hop + 1 FROM h JOIN u ON u.src = h.node WHERE hop < 3) SELECT node, CAST(min(hop) AS INTEGER) AS hop FROM h GROUP BY node HAVING min(hop) > 0 ORDER BY hop, node LIMIT 30""",
    "global_communities": f"WITH {_G} SELECT community, round(coalesce(list_cosine_similarity(v, q), 0), 6) AS similarity FROM c, q",
    "graph_searches": "SELECT unnest(['global', 'local', 'drift']) AS strategy, CAST(NULL AS VARCHAR) AS error, true AS timed, true AS counted",
    "embedded_texts": "SELECT id, 1.0::DOUBLE AS square FROM entities",
    "community_invariants": f"WITH {_E} SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS level, true AS once, true AS nested, (SELECT count(DISTINCT src) FROM u) AS nodes",
}

"""Stores, sinks, collections, page fetching, casts, maps, and joined texts."""

import json

from pyspark.sql import functions as F

from skein.functions import values
from skein.operators import chunking, graph
from skein.providers import HashEmbedder
from skein.sources import crawl, store
from skein.sources.collections import Collections


def test_collections(spark, tmp_path):
    class Picky:
        width = 8

        def embed(self, texts):
            if "bad" in texts:
                raise ValueError("bad")
            return HashEmbedder(8).embed(texts)

    rows = spark.createDataFrame([(1, "t", "red dust", 1), (2, None, "blue ice dust", 1), (3, "t", None, 1)], "doc_id bigint, title string, text string, weights int").coalesce(1)
    kept = Collections(spark, str(tmp_path))
    for _ in range(2):  # created anew, not added to
        kept.create()
        kept.upload(rows, HashEmbedder(8))
    found = {name: kept.search(name, rows.where("doc_id = 2"), HashEmbedder(8), 2) for name in ("dense", "sparse", "hybrid", "unknown")}
    assert [found[n].count() for n in found] == [2, 2, 2, 0] and found["unknown"].columns == found["dense"].select("query_id", "doc_id", "score", "rank").columns
    assert found["sparse"].orderBy("rank").first()["doc_id"] == 2
    every = kept.search_all(rows.where("doc_id = 2"), HashEmbedder(8), 2)
    assert every.count() == 6 and every.where("time_taken > 0").count() == 6
    kept.create()
    kept.upload(rows.limit(0), HashEmbedder(8))
    kept.upload(spark.createDataFrame([(9, "t", "bad")], "doc_id bigint, title string, text string"), Picky())
    assert kept.search("sparse", rows, HashEmbedder(8)).isEmpty()


def test_database_sink(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    records = spark.createDataFrame([("dense", 0.5, "q"), ("sparse", None, "r"), ("dense", 0.7, "s"), (None, 0.1, "t")], "search_type string, relevancy double, query string")
    stats = spark.createDataFrame([("LLM", 3)], "graph_type string, number_of_nodes int")
    properties = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    assert store.load_all(records, stats, url, properties) == ["dense_metrics", "sparse_metrics", "graph_statistics"]
    assert spark.read.jdbc(url, "dense_metrics", properties=properties).count() == 2
    assert spark.read.jdbc(url, "graph_statistics", properties=properties).first()[1] == 3
    store.write_statistics(stats, str(tmp_path / "s.json"))
    row = json.loads("".join(p.read_text() for p in (tmp_path / "s.json").glob("*.json")))
    assert list(row) == list(store.STATISTICS) and row["diameter"] is None


def test_pages_are_fetched_and_stored(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.md").write_text(f"page {k}")
    urls = spark.createDataFrame([(f"file://{tmp_path}/{k}.md",) for k in (0, 1, 2, 1, 7)] + [(None,)], "url string")
    found = crawl.fetch_pages(urls, crawl.FileFetcher)
    assert sorted(r["chunk"] or "-" for r in found.collect()) == ["-", "page 0", "page 1", "page 2"]
    assert found.where("error LIKE 'FileNotFoundError%'").count() == 1
    for _ in range(2):
        crawl.store_pages(found, str(tmp_path / "pages"))
    assert spark.read.json(str(tmp_path / "pages")).count() == 6


def test_store_keeps_the_last_of_a_key(spark, tmp_path):
    rows = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), (None, "x", 3), ("b", None, 1)], "id string, title string, _sequence int")
    kept = store.GraphStore(spark, str(tmp_path))
    assert kept.write("DL", {"entity": rows, "chunk": rows.limit(0)}) == {"chunk": ["no rows"]}
    assert {tuple(r) for r in kept.read("DL", "entity").collect()} == {("a", "new"), ("b", None)}


def test_casts_and_maps(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert [get(values.number_or(F.lit(x))) for x in ("1.5", "x", None)] == [1.5, 0.0, 0.0]
    assert get(values.whole_or(F.lit("7"))) == 7 and get(values.truth_or(F.lit("maybe"), True)) is True
    a, b, none = F.create_map(F.lit("k"), F.lit("1"), F.lit("l"), F.lit("2")), F.create_map(F.lit("k"), F.lit("3")), F.lit(None).cast("map<string,string>")
    assert get(values.merged(a, none, b)) == {"l": "2", "k": "3"} and get(values.merged(none)) == {}
    assert get(values.value_of(none, "k", "d")) == "d" and get(values.truncated(F.lit("abc"), 2)) == "ab"


def test_parts_of_joined_texts(spark):
    rows = spark.createDataFrame([("a", i, "x" * (i % 7), 0) for i in range(200)] + [("b", 500, None, 0), ("b", 501, "y", 0), (None, 502, "z", 0)], "g string, k int, t string, start int")
    got = {(r["g"], r["k"]): r["start"] for r in chunking.corpus_parts(rows, "g", "k", "t").collect()}
    at = 0
    for i in range(200):
        assert got["a", i] == at
        at += i % 7 + 2
    assert got["b", 501] == 0 and len(got) == 201


def test_texts_of_communities(spark):
    communities = spark.createDataFrame([(1, "T", None), (2, None, "")], "community int, title string, summary string")
    entities = spark.createDataFrame([("a", "A", "first", 2), ("b", "B", None, 9), ("c", None, None, None)], "id string, title string, description string, degree int")
    members = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "x")], "community int, node string")
    assert {r[0]: r[1] for r in graph.community_texts(communities, members.distinct(), entities).collect()} == {1: "T B A first", 2: "Empty community"}
    assert {r[0]: r[1] for r in graph.entity_texts(entities).collect()} == {"a": "A first", "b": "B", "c": "Unknown entity"}

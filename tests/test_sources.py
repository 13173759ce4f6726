"""Sources, stores, streams, searches and the catalogue."""

import json

from pyspark.sql import functions as F

from skein.operators import search
from skein.providers import ExtractiveAnswerer, HashEmbedder, embed_rows, names_in
from skein.sources import readers, store
from skein.streaming import streams


def test_page_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"chunk": "c", "url": "u", "timestamp": "2026-01-01T00:00:00"}, {"chunk": None, "url": "v"}]))
    (tmp_path / "b.json").write_text("{broken")
    rows = readers.page_json(spark, str(tmp_path)).collect()
    assert [(r["chunk"], r["url"], r["crawled_at"].year) for r in rows] == [("c", "u", 2026)]
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "q.json").write_text(json.dumps({"level_1": [{"question": "q", "answer": "a"}]}))
    assert readers.question_json(spark, str(tmp_path / "q")).first()["answer"] == "a"


def test_graph_store(spark, tmp_path):
    nodes = spark.createDataFrame([("1", "a"), ("1", "a"), (None, "x")], "id string, name string")
    graph = store.GraphStore(spark, str(tmp_path))
    assert graph.write("DL", {"entity": nodes, "related": nodes.drop("id")}) == {"related": ["missing column id"]}
    graph.write("LLM", {"entity": nodes})
    assert graph.read("DL", "entity").count() == 1 and sorted(r[0] for r in graph.prefixes().collect()) == ["DL", "LLM"]
    graph.clear("DL")
    assert [r[0] for r in graph.prefixes().collect()] == ["LLM"]
    assert store.issues(None, []) == ["no table"] and store.issues(nodes.limit(0), ["id"]) == ["no rows"]
    assert store.repeated_keys(nodes, ["id"]).first()["n"] == 2
    deep = nodes.select("id", F.array(F.struct("name")).alias("findings"))
    assert store.as_json_text(deep).where("id = '1'").first()["findings"] == '[{"name":"a"}]'
    last = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new")], "id string, n int, v string")
    assert store.last_wins(last, ["id"], "n").first()["v"] == "new"


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "one text"), (2, None), (2, None)], "id int, text string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        source = streams.read_stream(spark, str(tmp_path / "in"), rows.schema)
        streams.embed_new(source, "id", "text", HashEmbedder(8), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    events = spark.sql("SELECT 1L AS user_id, 'a' AS event_type, 2.0D AS value, explode(array(timestamp_ntz'2026-01-01 00:10:00', timestamp_ntz'2026-01-01 00:20:00', timestamp_ntz'2026-01-01 03:00:00')) AS ts")
    assert sorted(r["events"] for r in streams.event_windows(events).collect()) == [1, 2] and streams.sessions(events).count() == 2
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    live = streams.event_windows(streams.read_stream(spark, str(tmp_path / "ev"), events.schema))
    streams.append(live, str(tmp_path / "win"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "win")).count() == 1  # the last window stays open until its watermark


def test_searches_on_a_small_graph(spark):
    entities = spark.createDataFrame([(str(i), f"Body {i}", "MOON", f"About body {i}", i, [1.0, float(i)]) for i in range(4)], "id string, title string, entity_type string, description string, degree int, embedding array<double>")
    relations = spark.createDataFrame([("r0", "0", "1", "DL_orbits_near", None, 0.9), ("r1", "1", "2", "x", "feeds", None)], "id string, source_id string, target_id string, relation_type string, description string, weight double")
    chunks = spark.createDataFrame([(f"c{i}", f"Doc {i}", f"Text {i}", 2, [1.0, float(i)]) for i in range(4)], "chunk_id string, title string, text string, n_tokens int, embedding array<double>")
    held = chunks.select("chunk_id", F.substring("chunk_id", 2, 1).alias("entity_id"))
    members = entities.select(F.when(F.col("id") < "1", 0).otherwise(1).alias("community"), F.col("id").alias("node"))
    rows = spark.createDataFrame([(0, 0, 5.0, [1.0, 0.0]), (1, 0, 2.0, [1.0, 2.0])], "community int, level int, rank double, embedding array<double>")
    parts = search.Graph(entities, relations, chunks, held, rows, members)
    names = names_in("Where is body 0?", entities)
    found = {r["strategy"]: r for r in search.graph_search(parts, [1.0, 0.0], names).collect()}
    assert "- **Body 0** --[orbits near]--> **Body 1**" in found["global"]["context"]
    assert found["local"]["context"].startswith("# Relevant Information") and "- Body 0 → related to → Body 1 (strength: 0.9)" in found["local"]["context"]
    assert found["drift"]["context"].startswith("## Detailed Evidence") and "### Context related to: Body 0" in found["drift"]["context"]
    assert all(r["approx_token_count"] == len(r["context"].split()) for r in found.values())


def test_providers(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "b a")], "id int, text string")
    got = {r["id"]: r["embedding"] for r in embed_rows(rows, "id", "text", HashEmbedder(16)).collect()}
    assert got[1] == got[3] and abs(sum(x * x for x in got[2]) - 1) < 1e-9
    assert ExtractiveAnswerer().answer("what is the core", "The sky is blue. The core is iron.") == "The core is iron."


def test_catalogue_names_fit():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 90

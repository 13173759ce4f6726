"""Queries over small folders of tables, against brute force."""

import re

from skein.operators.retrieval import term_weights
from skein.plans import search_queries, vector_queries


def brute_sparse(texts, k):
    weights = {i: term_weights(re.findall("[a-z0-9]+", (t or "").lower())) for i, t in texts.items()}
    out = set()
    for q in (i for i, t in texts.items() if i % 20 == 0 and t is not None):
        scores = {i: sum(w * weights[q].get(t, 0.0) for t, w in own.items()) for i, own in weights.items()}
        out |= {(q, i) for i in sorted((i for i, s in scores.items() if s > 0), key=lambda i: (-round(scores[i], 9), i))[:k]}
    return out


def folder_of(spark, path, texts, vectors):
    documents = [(i, t, f"title {i}") for i, t in texts.items()]
    spark.createDataFrame(documents, "doc_id bigint, text string, title string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_texts_without_vector_are_searched_and_asked(spark, tmp_path):
    texts = {i: f"planet word{i % 7} moon{i % 5} ring{i}" for i in range(61)} | {61: None, 80: None}
    folder = folder_of(spark, tmp_path, texts, {i: [float(i % 3), 1.0] for i in range(30)})
    got = {(r["query_id"], r["doc_id"]) for r in vector_queries.bm25_tf_topk(spark, folder).collect()}
    assert got == brute_sparse(texts, 4) and {q for q, _ in got} == {0, 20, 40, 60}
    strategies = {(r["strategy"], r["query_id"]) for r in vector_queries.vector_strategies(spark, folder).collect()}
    assert strategies == {(s, q) for s in ("sparse", "hybrid") for q in (0, 20, 40, 60)} | {("dense", 0), ("dense", 20)}


def test_whole_texts_ask(spark, tmp_path):
    texts = {0: "dust " * 60 + "comet", 1: "comet", 2: "other"}
    folder = folder_of(spark, tmp_path, texts, {0: [1.0, 0.0]})
    got = {(r["query_id"], r["doc_id"]) for r in vector_queries.bm25_tf_topk(spark, folder).collect()}
    assert got == brute_sparse(texts, 4) == {(0, 0), (0, 1)}


def test_chunks_of_the_graph_without_vector_are_kept(spark, tmp_path):
    folder = folder_of(spark, tmp_path, {0: "a", 1: "b"}, {0: [1.0, 0.0]})
    entities = [(n, f"e{n}", f"T{n}", "d", "X", 1) for n in range(2)]
    spark.createDataFrame(entities, "human_readable_id bigint, id string, title string, description string, entity_type string, degree int").write.parquet(f"{folder}/entities.parquet")
    spark.createDataFrame([("r", "T0", "T1", "R", "d", 1.0)], "id string, source_title string, target_title string, relation_type string, description string, weight double").write.parquet(f"{folder}/relationships.parquet")
    parts, _ = search_queries._graph(spark, folder)
    assert {(r["chunk_id"], r["embedding"] is None) for r in parts.chunks.collect()} == {("0", False), ("1", True)}

"""Operators whose values a model writes, with models that fail at times."""

import json

import pytest

from skein.operators import evaluation, generation
from skein.providers import Reply, Scripted, fail, fenced, generator, word_tokens


def fickle(failures):
    """Makes a model that fails at the first tries of every prompt."""

    class Fickle:
        name = "fickle"

        def __init__(self):
            self.seen = {}

        def generate(self, prompt):
            self.seen[prompt] = self.seen.get(prompt, 0) + 1
            if self.seen[prompt] <= failures:
                raise TimeoutError("busy")
            return Reply(prompt[::-1], 1, 2)

    return Fickle


def test_retries_fallbacks_and_errors(spark):
    rows = spark.createDataFrame([(1, "abc", 7), (2, None, 8), (3, "", 9)], "k int, p string, answer int").drop("answer")
    got = {r["k"]: r for r in generation.complete(rows, ["k"], rows["p"], fickle(2), tries=3, delay=0).collect()}
    assert (got[1]["answer"], got[1]["tries"], got[1]["error"], got[1]["total_tokens"]) == ("cba", 3, None, 3)
    assert got[2]["answer"] is None and got[2]["tries"] == 0 and got[3]["answer"] == ""
    got = {r["k"]: r for r in generation.complete(rows, ["k"], rows["p"], fickle(5), tries=2, delay=0).collect()}
    assert got[1]["answer"] is None and got[1]["error"] == "TimeoutError: busy" and got[1]["tries"] == 2
    got = {r["k"]: r for r in generation.complete(rows, ["k"], rows["p"], fickle(5), lambda: Scripted("second", str.upper), tries=2, delay=0).collect()}
    assert (got[1]["answer"], got[1]["model"]) == ("ABC", "second")
    refused = generation.complete(rows, ["k"], rows["p"], lambda: Scripted("bare", str.upper), tries=2, delay=0, accept=generation._is_json).collect()
    assert all(r["answer"] is None for r in refused)
    assert generation.complete(rows.limit(0), ["k"], rows["p"], fickle(0)).isEmpty()


def test_broken_replies_of_a_reranker(spark):
    rows = spark.createDataFrame([("q", i, None if i == 3 else f"t{i}", i / 10) for i in range(6)], "query_id string, chunk_id int, text string, relevance double")
    listed = lambda m: fenced([{"chunk_id": str(c["chunk_id"]), "llm_relevance_score": 0.9 if c["chunk_id"] == "4" else "x"} for c in json.loads(m)])
    assert [(r["chunk_id"], r["score"], r["justification"]) for r in generation.rerank(rows, "?", lambda: Scripted("s", listed), batch=4, delay=0).collect()] == [(4, 0.9, "")]
    broken = lambda m: "no json" if len(json.loads(m)) == 4 else listed(m)
    got = {r["chunk_id"]: r["score"] for r in generation.rerank(rows, "?", lambda: Scripted("s", broken), batch=4, delay=0).collect()}
    assert got == {5: 0.5, 4: 0.4, 3: 0.3, 2: 0.2}  # the first batch keeps its relevance, the second has no number above 0.1
    assert generation.rerank(rows.limit(0), "?", lambda: Scripted("s", listed), delay=0).isEmpty()


def test_judges_fall_back_only_to_another_model(spark):
    class Never:
        name = "never"

        def score(self, *sides):
            raise TimeoutError

    rows = spark.createDataFrame([(1, "q", "a", "e", None)], "record_id int, query string, actual_output string, expected_output string, retrieval_context string")
    attempts = generation.judged(rows, "record_id", Never, Never, tries=2, delay=0)
    assert attempts.count() == 6
    flags = evaluation.resolve_attempts(attempts).collect()
    assert all(r["final_state_failed"] and not r["fallback_used_and_succeeded"] and r["score"] is None for r in flags)


def test_reports_and_registry(spark):
    entities = spark.createDataFrame([(1, "A", "X", None, 3), (1, "B", None, "d", None), (2, "C", "X", "d", 1)], "community int, title string, entity_type string, description string, degree int")
    relations = spark.createDataFrame([(1, "A", "B", None, 0.5)], "community int, source string, target string, description string, weight double")
    got = {r["community"]: r for r in generation.model_reports(entities, relations, lambda: Scripted("f", fail), delay=0).collect()}
    assert got[1]["summary"] == "This community contains 2 entities and 1 relationships." and got[2]["title"] == "Community 2" and not got[1]["written"]
    assert generator("titles").generate("Title\n---\n" + "w " * 20).text == " ".join("w" * 8) and word_tokens(None) == 0
    with pytest.raises(KeyError):
        generator("unknown")

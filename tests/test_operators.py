"""Operators against brute force and hand-checked cases."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from skein.functions import partition
from skein.functions.fuzzy import weighted_ratio
from skein.operators import chunking, communities, evaluation, graph, qa, resolution, retrieval, traversal, triplets
from skein.operators.components import connected_components


def test_token_windows(spark):
    frame = spark.createDataFrame([(1, " ".join(map(str, range(1000)))), (2, None), (3, "  "), (4, "a b")], "k bigint, t string")
    got = [(r["k"], r["pos"], r["n_tokens"], r["chunk"].split()[0]) for r in chunking.token_windows(frame, "k", "t").collect()]
    assert sorted(got) == [(1, 0, 400, "0"), (1, 1, 400, "393"), (1, 2, 214, "786"), (4, 0, 2, "a")]


def test_numbering_and_budget(spark):
    frame = spark.createDataFrame([(i, "w " * (i % 5)) for i in range(200)], "k bigint, t string")
    assert sorted((r["k"], r["n"]) for r in chunking.numbered(frame, ["k"], "n").collect()) == [(i, i) for i in range(200)]
    kept = chunking.sample_under_budget(frame, "k", "t", 100).collect()
    total = sum(r["n_tokens"] for r in kept)
    assert 96 < total <= 100 and max(r["running"] for r in kept) == total
    assert chunking.sample_under_budget(frame, "k", "t", 10**6).count() == 200


def test_fusion(spark):
    rank = lambda ids: spark.createDataFrame([(0, k, i + 1) for i, k in enumerate(ids)], "query_id bigint, doc_id bigint, rank int")
    got = {r["doc_id"]: round(r["score"], 6) for r in retrieval.fuse([rank([1, 2, 3]), rank([2, 4])], 9, "doc_id").collect()}
    assert got == {2: 0.032522, 1: 0.016393, 4: 0.016129, 3: 0.015873}


def test_nearest_in_blocks_with_ties(spark):
    rng = random.Random(0)
    vectors = [(i, [rng.choice([0.0, 1.0, -1.0]) for _ in range(3)]) for i in range(60)] + [(60, None)]
    points = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    asked = points.where("vec_id % 20 = 0 AND embedding IS NOT NULL").select("vec_id", "embedding")
    whole = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in retrieval.nearest(points, asked, 7).collect())
    assert whole == sorted((r["query_id"], r["rank"], r["vec_id"]) for r in retrieval.nearest(points.repartition(5), asked, 7, block=1).collect())

    def cosine(a, b):
        size = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / size if size else 0.0

    for q in {k[0] for k in whole}:
        order = sorted((v for v in vectors if v[1]), key=lambda v: (-round(cosine(vectors[q][1], v[1]), 9), v[0]))[:7]
        scores = lambda ids: [round(cosine(vectors[q][1], vectors[i][1]), 9) for i in ids]
        assert scores([v for _, _, v in sorted(k for k in whole if k[0] == q)]) == scores([v[0] for v in order])


def test_triplet_filter(spark):
    rows = [(0, "Mars", "Sun"), (1, "mars ", "SUN"), (2, "A", "Sun"), (3, "Sun", "sun"), (4, None, "Sun")]
    frame = spark.createDataFrame([(1, *r) for r in rows], "s int, seq int, head string, tail string")
    assert [r["seq"] for r in graph.filter_triplets(frame, ["s"], ["seq"]).collect()] == [0]


def test_linear_triplets(spark):
    frame = spark.createDataFrame([(1, "<s><triplet> Mars <subj> Sun <obj> orbits <subj> Phobos <obj> has moon <triplet> Io <subj> Jupiter <obj> moon of</s>"), (2, None), (3, "<triplet> A <subj> B")], "k int, t string")
    got = sorted((r["head"], r["type"], r["tail"]) for r in triplets.parse_linear(frame, "k", "t").collect())
    assert got == [("Io", "moon of", "Jupiter"), ("Mars", "has moon", "Phobos"), ("Mars", "orbits", "Sun")]
    found = triplets.regular_triplets(frame.selectExpr("k", "'Io orbits Jupiter' AS t"), "k", "t", r"(\w+) (orbits) (\w+)").collect()
    assert [(r["head"], r["type"], r["tail"]) for r in found] == [("Io", "orbits", "Jupiter")] * 3


def test_mention_types(spark):
    names = spark.createDataFrame([(1, "Ceres"), (1, "Vestaa"), (1, "Zzz"), (2, "Ceres")], "s int, name string")
    words = spark.createDataFrame([(1, 0, "Ceress", "X"), (1, 1, "Ceres", "LOC"), (1, 2, "Vesta", "ORG")], "s int, pos int, word string, kind string")
    got = {(r["s"], r["name"]): r["type"] for r in triplets.mention_types(names, words, "s").collect()}
    assert got == {(1, "Ceres"): "LOC", (1, "Vestaa"): "ORG", (1, "Zzz"): "REBEL_ENTITY", (2, "Ceres"): "REBEL_ENTITY"}


def test_canonical_form_and_similar_names(spark):
    frame = spark.createDataFrame([(1, "Mars", "MISC", 1), (1, "Planet Mars", "LOC", 5)], "c int, mention string, type string, freq int")
    assert resolution.canonical_forms(frame, "c").first()["canonical"] == "Mars"
    assert resolution.canonical_forms(frame, "c", prefer_specific=True).first()["canonical"] == "Planet Mars"

    rng = random.Random(3)
    names = set()
    for _ in range(60):
        base = [rng.choice("abcd") for _ in range(rng.randint(1, 22))]
        names.add("".join(base))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(base))
            base[at : at + rng.randint(0, 1)] = [rng.choice("abcd")] * rng.randint(0, 2)
            base = base or ["a"]
        names.add("".join(base))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    got = {(r["a"], r["b"]) for r in resolution.similar_names(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {(a, b) for a in names for b in names if a < b and 100 * distance(a, b) <= 15 * max(len(a), len(b))}


def test_resolution_joins_spellings(spark):
    rows = [("Enceladus Station", "X", "Saturn", "LOC")] * 3 + [("Enceladus Statoin", "X", "Saturn", "LOC"), ("Enceladus Station", "X", "Enceladus Statoin", "X"), (None, None, "Saturn", "LOC")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, head string, head_type string, tail string, tail_type string")
    got = {r["id"]: r["head"] for r in resolution.resolve(frame).collect()}
    assert got == {0: "Enceladus Station", 1: "Enceladus Station", 2: "Enceladus Station", 3: "Enceladus Station", 5: None}


GRAPH = [(1, 2), (2, 3), (3, 1), (3, 4), (5, 6)]


def test_components_and_distances(spark):
    edges = spark.createDataFrame(GRAPH, "src bigint, dst bigint")
    stats = traversal.component_statistics(edges).first()
    assert tuple(stats) == (2, 4, 4, 3)
    core = traversal.largest(traversal.strong_components(edges))
    inside = edges.join(core.withColumnRenamed("node", "src"), "src", "left_semi").join(core.withColumnRenamed("node", "dst"), "dst", "left_semi")
    found = traversal.distances(inside, core)
    assert found.where("hop > 0").agg(F.avg("hop")).first()[0] == 1.5
    ways = graph.undirected(edges, "src", "dst")
    ecc = traversal.distances(ways, traversal.largest(connected_components(ways))).groupBy("source").agg(F.max("hop").alias("e")).agg(F.max("e"), F.min("e")).first()
    assert tuple(ecc) == (2, 1)


def test_components_of_random_graphs_and_a_long_chain(spark):
    rng = random.Random(8)
    pairs = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 160)] + [(200, 200), (None, 3)]
    edges = spark.createDataFrame(pairs, "src bigint, dst bigint")
    root = {n: n for p in pairs if None not in p for n in p}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        if a is not None:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    assert {r["node"]: r["component"] for r in connected_components(edges).collect()} == {n: top(n) for n in root}
    assert connected_components(edges.limit(0)).isEmpty()


def test_hops(spark):
    names = "abcdef"
    chain = spark.createDataFrame([(names[i], names[i + 1]) for i in range(5)], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert [r["node"] for r in traversal.hops(graph.undirected(chain, "src", "dst"), seeds, 4, 20).collect()] == list("bcde")


def test_communities(spark):
    cliques = [(a + 10 * k, b + 10 * k) for k in range(2) for a in range(4) for b in range(4) if a != b] + [(0, 10), (10, 0)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in cliques], "src bigint, dst bigint, weight double")
    nodes = edges.select(F.col("src").alias("node")).distinct().withColumn("parent", F.lit(0))
    labels = communities.potts_communities(edges, nodes, 0.5)
    groups = defaultdict(set)
    for r in labels.collect():
        groups[r["label"]].add(r["node"])
    start = communities.objective(edges, nodes.select("node", F.col("node").alias("label")), 0.5)
    assert communities.objective(edges, labels, 0.5) >= start and all(max(g) - min(g) < 10 for g in groups.values())
    rows = communities.communities(communities.hierarchy(edges)).collect()
    levels = {r["level"]: [x for x in rows if x["level"] == r["level"]] for r in rows}
    assert [r["community"] for r in levels[0]] == [0] and levels[0][0]["parent"] == -1 and levels[0][0]["size"] == 8
    assert sorted(levels[0][0]["children"]) == sorted(r["community"] for r in levels[1]) and all(r["community"] >= 1000 for r in levels[1])


def test_importance_and_scores(spark):
    score = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert score(communities.importance(F.lit(4.0), F.lit(0.5))) == 2.9
    assert round(score(evaluation.rouge1(F.lit("the cat sat"), F.lit("the cat ran fast"))), 6) == 0.571429
    assert score(evaluation.rouge1(F.lit(None).cast("string"), F.lit("a"))) == 0
    assert round(score(evaluation.ranked_precision(F.array(F.lit(1), F.lit(0), F.lit(1)))), 6) == 0.833333
    assert score(evaluation.share(F.array(F.lit(1), F.lit(0)))) == 0.5


def test_boost_cuts_before_it_removes_repeats(spark):
    rows = [("e", i, "same" if i < 2 else f"t{i}", 0.9 - i / 100, False) for i in range(31)]
    frame = spark.createDataFrame(rows, "entity_id string, chunk_id bigint, text string, relevance double, is_seed boolean")
    assert retrieval.boosted(frame).count() == 29
    two = spark.createDataFrame([("a", 1, "x", 0.700, True), ("b", 2, "y", 0.715, False)], frame.schema)
    assert retrieval.boosted(two).orderBy(F.desc("score")).first()["chunk_id"] == 2


def test_fallback_and_timestamps(spark):
    rows = [(1, "r", "primary", 1, None), (1, "r", "fallback", 1, 0.8), (2, "r", "primary", 1, None), (2, "r", "primary", 2, 0.5), (3, "r", "primary", 1, None)]
    got = {r["record_id"]: tuple(r)[2:] for r in evaluation.resolve_attempts(spark.createDataFrame(rows, "record_id int, metric string, model string, attempt int, score double")).collect()}
    assert got == {1: (0.8, True, False), 2: (0.5, False, False), 3: (None, False, True)}
    times = evaluation.with_timestamps(spark.range(3), ["id"], "2026-01-01 00:00:00").orderBy("id").collect()
    assert [r["created_at"].second for r in times] == [0, 1, 2]


def test_questions(spark):
    nested = '{"level_1": [{"question": "q", "answer": "a"}, {"question": "q", "answer": "b"}], "level_2": [{"question": "q", "answer": " "}]}'
    flat = qa.flatten(spark.createDataFrame([(nested,), ("broken",), (None,)], "t string"), "t")
    assert flat.count() == 3 and qa.valid(flat).count() == 2
    kept = qa.without_repeats(flat, ["pos"]).collect()
    assert sorted((r["qa_level"], r["answer"]) for r in kept) == [("level_1", "a"), ("level_2", " ")]


def every_partition(n):
    def grow(labels):
        if len(labels) == n:
            yield labels
            return
        for c in range(max(labels, default=-1) + 2):
            yield from grow([*labels, c])

    yield from grow([])


def test_partition_is_as_good_as_the_best_of_all():
    rng = random.Random(2)
    for _ in range(12):
        pairs = [(a, b, round(rng.uniform(0.1, 1), 2)) for a in range(7) for b in range(a) if rng.random() < 0.45]
        resolution = rng.choice([0.05, 0.2, 0.4])
        near = [{} for _ in range(7)]
        for a, b, w in pairs:
            near[a][b] = near[b][a] = w
        value = lambda labels: partition.quality(near, [1.0] * 7, labels, resolution)  # noqa: E731, B023
        got = partition.potts_partition(*(np.array([p[k] for p in pairs]) for k in range(3)), np.ones(7), resolution)
        assert value(got) >= 0.99 * max(map(value, every_partition(7)))


def test_large_parts_are_contracted_first(spark):
    rng = random.Random(4)
    pairs = {(a + 8 * k, b + 8 * k) for k in range(12) for a in range(8) for b in range(a) if rng.random() < 0.8} | {(8 * k, 8 * k + 8) for k in range(11)}
    rows = [x for a, b in pairs for x in ((a, b, 1.0), (b, a, 1.0))]
    edges = spark.createDataFrame(rows, "src bigint, dst bigint, weight double")
    nodes = spark.range(100).withColumnRenamed("id", "node").withColumn("parent", F.lit(0))
    whole, cut = (communities.potts_communities(edges, nodes, 0.3, task_edges=n) for n in (10_000, 60))
    best, least = communities.objective(edges, whole, 0.3), communities.objective(edges, cut, 0.3)
    assert least >= 0.97 * best and whole.count() == cut.count() == 100
    for found in (whole, cut):
        label = {r["node"]: r["label"] for r in found.collect()}
        for c in set(label.values()):
            inside, seen, stack = {v for v in label if label[v] == c}, set(), [c]
            while stack:
                v = stack.pop()
                if v not in seen:
                    seen.add(v)
                    stack += [b for a, b, _ in rows if a == v and b in inside]
            assert seen == inside


def test_weighted_names_and_clusters_are_those_of_all_pairs(spark):
    rng = random.Random(9)
    words = ["new", "horizons", "probe", "saturn", "rings", "kuiper", "belt", "object", "voyager", "dust", "ring", "moon", "orbit", "cloud"]
    names = {" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(60)} | {"new horizon", "saturns rings", "kuiperbelt", "voyagers", "the kuiper belt object", ""}
    frame = spark.createDataFrame([(n, 1) for n in sorted(names)] + [(None, 2)], "name string, score int")
    want = {(a, b): round(weighted_ratio(a, b), 6) for a in names for b in names if a and a < b and weighted_ratio(a, b) >= 85}
    got = {(r["a"], r["b"]): round(r["score"], 6) for r in resolution.weighted_names(frame).collect()}
    assert ("new horizons", "new horizons probe") in want or len(want) > 20
    assert got.items() <= want.items() and len(got) >= 0.95 * len(want)
    listed = sorted(n for n in names if n)
    label = resolution.average_linkage(listed)
    clusters = defaultdict(set)
    for n, k in zip(listed, label):
        clusters[k].add(n)
    found = defaultdict(set)
    for r in resolution.name_clusters(frame).collect():
        found[r["cluster"]].add(r["name"])
    assert {frozenset(c) for c in found.values() if len(c) > 1} == {frozenset(c) for c in clusters.values() if len(c) > 1}
    links = spark.createDataFrame([(f"n{i:03}", f"n{j:03}", 85.0 + (i % 15)) for i in range(60) for j in (i + 1, i + 2)], "a string, b string, score double")
    parts = resolution.linked_parts(links, most=7).groupBy("component").count().collect()
    assert max(r["count"] for r in parts) <= 7
    same = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}", 100.0) for i in range(60)], "a string, b string, score double")
    parts = resolution.linked_parts(same, most=7).groupBy("component").count().collect()
    assert max(r["count"] for r in parts) <= 7 and sum(r["count"] for r in parts) == 61


def test_similar_names_are_not_broadcast_and_verified_where_they_meet(spark):
    names = ["ab😀defghijklmn", "ab😁defghijklmn", "abédefghijklm😀", "abcdefghijklmn", "abcdefghijklmno"]
    pairs = resolution.similar_names(spark.createDataFrame([(n,) for n in names], "name string"))
    assert {(r["a"], r["b"], r["distance"]) for r in pairs.collect()} == {
        ("ab😀defghijklmn", "ab😁defghijklmn", 1), ("abcdefghijklmn", "ab😀defghijklmn", 1), ("abcdefghijklmn", "ab😁defghijklmn", 1), ("abcdefghijklmn", "abcdefghijklmno", 1),
        ("abcdefghijklmno", "ab😀defghijklmn", 2), ("abcdefghijklmno", "ab😁defghijklmn", 2), ("abcdefghijklmn", "abédefghijklm😀", 2), ("abédefghijklm😀", "ab😀defghijklmn", 2), ("abédefghijklm😀", "ab😁defghijklmn", 2),
    }
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_wider_similarity_is_exact_and_not_broadcast(spark):
    """The width that weighted pairs ask for, 75 %, on names like those of the tables."""
    rng = random.Random(4)
    names = sorted({rng.choice(["kor", "vel", "kir"]) + rng.choice(["il", "or"]) + rng.choice(["gar", "tane"]) + f" {rng.randint(0, 999)}" for _ in range(120)})
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    pairs = resolution.similar_names(frame, "name", resolution.PERCENT - resolution.EDITS)
    every = frame.toDF("a").crossJoin(frame.toDF("b")).where("a < b").selectExpr("a", "b", "levenshtein(a, b) AS distance").where("100 * distance <= 25 * greatest(length(a), length(b))")
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, every.collect()))
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()

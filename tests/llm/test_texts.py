"""Problems 3, 6, 7 and 8: answers, tokens, leaks, abuse; and the verified MinHash classes."""

import random
from pathlib import Path

import pytest

from skein.llm import abuse, leakage, minhash, pairs, tokens

RECORDS = "record_id bigint, query string, actual_output string, expected_output string, defect string, opening string"
Q = "How long does Velor 123 take to complete one orbit around Other 9?"


def records(spark, rows):
    return spark.createDataFrame([(i, q, a, e, "x", "y") for i, q, a, e in rows], RECORDS)


def test_broken_pairs(spark):
    good = "Velor 123 completes one orbit around Other 9 in 18.2 h."
    rows = [
        (1, Q, None, "  "), (2, Q, "N/A", "..."), (3, Q, Q.upper(), f'"Question: {Q}"'), (4, Q, good, "18.2 h"),
        (5, Q, "Velor 123 completes one orbit around Other 9 in 18.2 h. The crust of Velor 123 is", "See also the table of the orbit of Velor 123 and (" ),
        (6, Q, "Die Sonde flog in 40 km Abstand an Velor 123 vorbei, und der Staub ist nicht von hier.", f'{good} The log adds: "Die Sonde flog nicht an dem Mond vorbei und ist weg."'),
        (7, "Who mapped Alpha 1?", "I'm sorry, but I can't answer that.", "Yes."),
        (8, "Is Beta 2 covered by ice?", "I'm sorry, but I can't answer that. Please try a different question.", good),
        (9, "Where is Gamma 3?", "I can't quote the passage in full, but the value is clear. Gamma 3 is 70 km away.", good),
        (10, "Where is Delta 4?", "I can't quote the passage in full, but the value is clear. It is 71 km away.", good),
        (11, None, good, "Answer:"), (12, Q, good + " " + "word " * 50000 + "end.", good),
    ]
    rows.append((7, *rows[6][1:]))
    got = sorted(tuple(r) for r in pairs.broken_pairs(records(spark, rows)).collect())
    a, e = pairs.FIELDS
    assert got == sorted([
        (1, a, "empty"), (1, e, "empty"), (2, a, "empty"), (2, e, "empty"), (3, a, "copied_question"), (3, e, "copied_question"), (5, a, "truncated"), (5, e, "truncated"),
        (6, a, "wrong_language"), (7, a, "refusal"), (7, a, "refusal"), (8, a, "refusal"), (11, e, "empty"),
    ])
    assert pairs.broken_pairs(records(spark, rows).limit(0)).isEmpty()


def test_classes_hold_every_link_of_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    base = [[rng.choice(words) for _ in range(24)] for _ in range(12)]
    texts = set()
    for b in base:
        for _ in range(8):
            t = list(b)
            if rng.random() < 0.7:
                t = t[: 24 - rng.randint(0, 3)]
            if rng.random() < 0.3:
                t[0] = "odd"
            texts.add(" ".join(t))
    texts = sorted(texts) + ["", "one two", "one two three"]
    frame = spark.createDataFrame(list(enumerate(texts)), "k bigint, t string")
    got = {r["k"]: r["class_key"] for r in minhash.text_classes(frame, "k", "t").collect()}
    sets = [minhash.shingles(t) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    assert got == {i: top(i) for i in range(len(texts))}
    block, minhash.BLOCK = minhash.BLOCK, 3  # buckets cut into pairs of blocks give the same classes
    try:
        assert {r["k"]: r["class_key"] for r in minhash.text_classes(frame, "k", "t").collect()} == got
    finally:
        minhash.BLOCK = block


needs_vocabulary = pytest.mark.skipif(not Path(tokens.FOLDER).exists(), reason="the public vocabularies are not here")


@needs_vocabulary
def test_tokens_match_the_merges(spark):
    import tiktoken

    own = tokens.Encoder(tokens.load_ranks())
    reference = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=own.rank, special_tokens={})
    rng = random.Random(2)
    texts = ["", "<|endoftext|> is text", "naïve 漢字 🙂​‍́", "a" * 5000, " \n\t  x", "It's we'll DON'T 12345"]
    texts += ["".join(rng.choice("abcdehlot niserx  é漢​1'\n") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    assert all(own.encode(t) == reference.encode_ordinary(t) for t in texts)
    frame = spark.createDataFrame([*enumerate(texts[:6]), (6, None), (0, "")], "doc_id bigint, text string")
    got = tokens.encode_texts(frame).collect()
    assert len(got) == 8 and {r["doc_id"]: list(r["ids"]) for r in got} == {**{i: reference.encode_ordinary(t) for i, t in enumerate(texts[:6])}, 6: []}
    assert tokens.encode_texts(frame.limit(0)).isEmpty()


def test_a_vocabulary_whose_longest_match_is_wrong():
    import base64

    ranks = {bytes([i]): i for i in range(256)}
    for k, t in enumerate((b"bc", b"ab", b"cd", b"abc", b"bcd")):
        ranks[t] = 256 + k
    own = tokens.Encoder(b"\n".join(base64.b64encode(t) + b" " + str(r).encode() for t, r in ranks.items()))
    rng = random.Random(3)
    for _ in range(500):
        data = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))).encode()
        assert own.piece(data) == own.merged(data)


def brute_leaks(docs, items, n):
    grams = {}
    for i, p in items:
        w = leakage.words_of((p or "").lower())
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = leakage.words_of((t or "").lower())
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


def test_leaks_match_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(6)]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", ",", " -", "**"]) for _ in range(n))
    items = [(i, text(rng.randint(2, 12))) for i in range(20)] + [(90, None), (91, ""), (0, text(9))]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(100, None), (101, ""), (102, "x " * 100000), (0, text(30))]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, passage string")
    want = brute_leaks(docs, items, 5)
    assert want and {tuple(r) for r in leakage.leaks(d, i, 5).collect()} == want
    assert {r[0] for r in leakage.without_leaks(d, i, 5).collect()} == {k for k, _ in docs} - {k for k, _ in want}
    block, leakage.BLOCK_WORDS = leakage.BLOCK_WORDS, 20
    try:
        assert {tuple(r) for r in leakage.leaks(d, i, 5).collect()} == want
    finally:
        leakage.BLOCK_WORDS = block
    assert leakage.leaks(d, i.limit(0)).isEmpty() and leakage.leaks(d.limit(0), i).isEmpty()


def test_longest_match_and_its_place():
    passages = leakage.Passages([(7, "a b c d e f")], 3)
    assert list(leakage.search(passages, ["x. B! c; D e", None, "a b x"])) == [(0, 7, 1, 4)]


BAD = ["You are a total idiot and nobody wants you here.", "Shut up, you bastard, nobody asked.", "They are vermin and should be driven off."]
GOOD = ["The crust of the moon is {} km thick.", "Two burns moved the craft to {} km.", "The dumb terminal only echoes {} commands.", "Radio silence lasts {} h."]


def corpus(rng, n):
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.2
        lines = [rng.choice(GOOD).format(rng.randint(1, 99)) for _ in range(4)] + ([rng.choice(BAD)] if bad else [])
        rng.shuffle(lines)
        docs.append((i, "\n".join(lines), f"s{i % 3}"))
        labels.append(bad)
    return docs, labels


def test_scores_on_held_out_documents(spark):
    rng = random.Random(6)
    docs, bad = corpus(rng, 400)
    wrong = {5, 17}  # verdicts can be wrong
    verdicts = [(i, "r", ("abusive" if bad[i] != (i in wrong) else "none")) for i in range(200)] + [(1, "q", None), (2, "q", "unsure"), (9999, "q", "abusive")]
    docs += [(400, None, "s0"), (401, "", None), (402, "B a s t a r d ! You are a total 1d10t.", "s1"), (403, "ok " * 30000, "s1"), (0, docs[0][1], "s0")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    v = spark.createDataFrame(verdicts, "doc_id bigint, reviewer string, verdict string")
    got = abuse.score_documents(d, v).collect()
    found = {r["doc_id"] for r in got if r["p_bad"] >= abuse.THRESHOLD}
    truth = {i for i in range(200, 400) if bad[i]}
    held = {i for i in found if 200 <= i < 400}
    assert len(got) == len(docs) and len(held & truth) >= 0.9 * len(truth) and len(held - truth) <= 2
    assert 402 in found and all(r["severity"] == 0 for r in got if r["doc_id"] in (400, 401))
    rates = {r["source"]: r for r in abuse.source_rates(d, v).collect()}
    assert sum(r["documents"] for r in rates.values()) == len(docs) and None in rates
    assert abuse.bad_documents(d, v.limit(0)).isEmpty() and abuse.bad_documents(d.limit(0), v).isEmpty()


def test_disguises():
    assert [abuse.undisguise(w) for w in ("s4l4ud", "crrrrétin", "1d10t", "12,5", "lorne473", "Word")] == ["salaud", "crétin", "idiot", "0", "0", "word"]
    assert abuse.passages("lorne473: Hi there. You i d i o t!\n​") == ["Hi there.", "You idiot!"]

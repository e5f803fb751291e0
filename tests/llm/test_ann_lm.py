import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkloam.llm import ann, lm


def _exact(vecs, own, k=5):
    out = []
    for i, v in vecs.items():
        if i != own and len(v) == len(vecs[own]):
            a, b = np.array(v), np.array(vecs[own])
            out.append((-float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)), i))
    return sorted(out)[:k]


def test_recall_on_the_table(spark):
    d = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    vecs = {r.vec_id: np.array(r.embedding, float) for r in rows.collect()}
    got = defaultdict(list)
    index = ann.build(rows, shard=128)
    for r in ann.search(index, rows.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    hit = 0
    for q in got:
        want = _exact(vecs, q)
        assert [r["rank"] for r in got[q]] == [1, 2, 3, 4, 5]
        hit += len({r.vec_id for r in got[q]} & {i for _, i in want})
        for r in got[q]:
            a, b = vecs[q], vecs[r.vec_id]
            assert r.score == pytest.approx(a @ b / math.sqrt((a @ a) * (b @ b)), abs=1e-12)
    assert len(got) == sum(i % 50 == 0 for i in vecs) and hit >= 0.9 * 5 * len(got)


def test_the_query_over_many_shards_and_blocks(spark, monkeypatch):
    """The registered query with shards of some 40 vectors, against all pairs."""
    d = "/root/testdata/sf0.01"
    monkeypatch.setitem(ann.build.__kwdefaults__, "shard", 40)
    monkeypatch.setitem(ann.search.__kwdefaults__, "block", 3)
    vecs = {r.vec_id: r.embedding for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    got = defaultdict(list)
    for r in ann.op8_hnsw(spark, d).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert sorted(got) == sorted(i for i in vecs if i % 50 == 0)
    hit = sum(len({*found} & {i for _, i in _exact(vecs, q)}) for q, found in got.items())
    assert hit >= 0.9 * 5 * len(got)


def test_queries_are_dealt_and_not_gathered(spark):
    """Their copies for all shards are too much for a broadcast, however small one of them is."""
    rows = spark.range(600).selectExpr("id AS vec_id", "transform(sequence(1, 8), i -> cast(sin(id * i + i) AS float)) AS embedding")
    found = ann.search(ann.build(rows, shard=40), rows.where("vec_id % 5 = 0"))
    assert len(found.collect()) == 600
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "BroadcastExchange" not in plan.split("== Initial Plan ==")[0]


def test_recall_in_one_large_shard():
    r = np.random.default_rng(1)
    x = ann._unit(r.normal(size=(3000, 32)))
    q = ann._unit(r.normal(size=(100, 32)))
    at, sim = ann.search_layers(x, ann.build_layers(x), q, 5)
    want = np.argsort(-(q @ x.T), axis=1)[:, :5]
    assert np.mean([len({*a} & {*b}) for a, b in zip(at, want)]) / 5 >= 0.9
    assert np.allclose(np.take_along_axis(q @ x.T, at, 1), sim)


def test_copies_ties_and_unusable_vectors(spark):
    rows = [(i, [1.0, 0.0], "a") for i in range(0, 300, 3)] + [(1, [0.0, 1.0], "b"), (2, [1.0, 1e-9], "c"), (4, None, "d"), (5, [0.0, 0.0], "d"), (7, [float("nan"), 1.0], "d"), (8, [None, 1.0], "d"), (10, [float("inf"), 1.0], "d"), (50, [3.0, 0.0], "e"), (100, [1.0, 2.0, 3.0], "f"), (200, [], "g"), (None, [1.0, 1.0], "h"), (0, [1.0, 0.0], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, ids string")
    out = ann.search(ann.build(df), df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    by = defaultdict(list)
    for r in out:
        by[r.query_id].append((r.vec_id, round(r.score, 12)))
    assert by[0] == [(2, 1.0), (3, 1.0), (6, 1.0), (9, 1.0), (12, 1.0)]
    assert by[50] == [(0, 1.0), (2, 1.0), (3, 1.0), (6, 1.0), (9, 1.0)]
    assert by[150] == [(0, 1.0), (2, 1.0), (3, 1.0), (6, 1.0), (9, 1.0)]
    assert 100 not in by and 200 not in by
    assert ann.search(ann.build(df.where("false")), df.where("vec_id = 0")).count() == 0
    assert ann.search(ann.build(df), df.where("false")).count() == 0


def _brute_trie(train, order):
    """Method C with exclusion, straight from the definition."""
    counts = defaultdict(Counter)
    for t in train:
        s = [256] * order + list(t) + [257]
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[tuple(s[i - k : i])][s[i]] += 1

    def p(ctx, x, out):
        while ctx and ctx not in counts:
            ctx = ctx[1:]
        c = {y: n for y, n in counts[ctx].items() if y not in out}
        total = sum(c.values())
        if x in c:
            return c[x] / (total + len(c))
        e = len(c) / (total + len(c)) if c else 1
        gone = out | set(c)
        return e * (p(ctx[1:], x, gone) if ctx else 1 / (257 - len(gone)))

    def score(t):
        s = [256] * order + list(t) + [257]
        return sum(math.log10(p(tuple(s[i - order : i]), s[i], frozenset())) for i in range(order, len(s)))

    return score


def test_model_and_base_scores(spark):
    r = random.Random(5)
    train = ["", "abra cadabra", "The cat and the Cat", "é è ñ"] + ["".join(r.choice("abc d\n") for _ in range(r.randrange(60))) for _ in range(40)]
    rest = ["abracad", "zzz ZZZ qqq", "", "x" * 5000, "THE cat\x1csat"]
    rows = [(i, t, False, 1) for i, t in enumerate(train)] + [(100 + i, t, True, 1) for i, t in enumerate(rest)] + [(0, train[0], False, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean, n int").drop("n")
    counts = lm.count(docs.where("not held_out"), order=3).cache()
    c = Counter(w for t in [*train, train[0]] for w in [*t.encode().lower().split(), b""])
    n, v = sum(c.values()), len(c)
    model = _brute_trie([t.encode() for t in [*train, train[0]]], 3)
    for words in (10_000, 3):
        out = lm.score(docs, counts, lm.fit(counts, order=3), keep=["doc_id", "held_out"], words=words).collect()
        assert len(out) == len(rows)
        for x in out:
            t = dict((i, t) for i, t, *_ in rows)[x.doc_id].encode()
            own = [*t.lower().split(), b""]
            assert (x.n_tokens, x.n_known, x.train_tokens) == (len(own), sum(c[w] > 0 for w in own), n)
            assert x.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own))
            assert x.score == pytest.approx(model(t), rel=1e-5, abs=1e-5)


@pytest.mark.parametrize("rows", [1 << 18, 7])
def test_contexts_beyond_the_broadcast_ones(spark, monkeypatch, rows):
    monkeypatch.setattr(lm, "ROWS", rows)
    r = random.Random(9)
    train = ["", "abra cadabra", "é è ñ"] + ["".join(r.choice("abc d\n") for _ in range(r.randrange(60))) for _ in range(40)]
    rest = ["abracad", "zzz ZZZ qqq", "", "x" * 5000, "abc\x1cabd é", "dab cab" * 9]
    docs = spark.createDataFrame(list(enumerate(train + rest)), "doc_id long, text string")
    counts = lm.count(docs.where(f"doc_id < {len(train)}")).cache()
    model = _brute_trie([t.encode() for t in train], 4)
    for contexts in (1, 20, 32_768):
        trie = lm.fit(counts, contexts=contexts)
        assert trie.whole == (contexts == 32_768)
        out = lm.score(docs, counts, trie, keep=["doc_id"], words=5).collect()
        assert sorted(x.doc_id for x in out) == list(range(len(train + rest)))
        for x in out:
            assert x.score == pytest.approx(model((train + rest)[x.doc_id].encode()), rel=1e-5, abs=1e-5)


def test_probabilities_of_a_context_sum_to_one():
    s, first = lm.symbols([b"abcabcabd", b"xyz"], 2)
    grams = [np.unique(lm._codes(s, first, 2) % (1 << 9 * (k + 1)), return_counts=True) for k in range(3)]
    trie = lm.Trie(grams)
    seen = len(grams[0][0])
    total = (10.0 ** trie.cost[:, :-1]).sum(axis=1) + (257 - seen) * 10.0 ** trie.cost[:, -1]
    assert np.allclose(total, 1, atol=1e-4)


def test_without_training_texts(spark):
    docs = spark.createDataFrame([(1, "a b", True)], "doc_id long, text string, held_out boolean")
    counts = lm.count(docs.where("not held_out"))
    x = lm.score(docs, counts, lm.fit(counts), keep=["doc_id"]).first()
    assert (x.n_tokens, x.n_known, x.train_tokens, x.base_score) == (3, 0, 0, 0.0) and x.score == pytest.approx(-4 * math.log10(257), rel=1e-5)
    assert lm.score(docs.where("false"), counts, lm.fit(counts), keep=["doc_id"]).count() == 0

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloam.llm import classifier, pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _base(t):
    out = []
    for order, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), order, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


KEY = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
TEXTS = [
    None, "", "a@b.c_d@e.f.g@h.i", "é🎉 x.y+z@mail-1.example.com, 1.2.3.4.5.6.7.8 300.1.2.3.4 0255.001.0.0", "4929348385146306 4929 3483 8514 6306 5-5 12", "+1 (017) 555-7713. +49(0)30-12 +12345678901234567 ++1 23 45 67 89 0",
    "x" * 50_000 + "@", "1" * 60_000, "1 2-3 " * 9000, "+" * 2000, "a.b@c." * 900, f'token = "{KEY}" and password: {KEY}', f"plain {KEY} here", "4929348385146306@x.y 1.1.1.1@b.c", "@@a@b.c@d.e", "79927398713 799273987130 0000000000000000",
]


def test_spans_equal_brute_force(spark):
    r = random.Random(1)
    bits = ["1", "23", "4", "a", ".", "@", "-", " ", "+", "(", ")", "_", "é", "255", ".1.2.3", "x@y.z", "4929348385146306", "\n"]
    texts = TEXTS + ["".join(r.choice(bits) for _ in range(r.randrange(60))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, 5, "m") for i, t in enumerate(texts)] + [(None, "a@b.c", 5, "m")], "doc_id long, text string, base int, t string")
    out = pii.spans(docs, pii.learn(docs)).select("doc_id", pii.listed("base").alias("base"), pii.listed("found").alias("found"), pii.masked().alias("masked"), "t").collect()
    assert len(out) == len(texts) + 1
    for x in out:
        assert x.base == ",".join(f"{k}:{s}:{e}" for k, s, e in _base(x.t)), x.t[:80]
        assert set(x.base.split(",")) <= set(x.found.split(",")) or not x.base
        found = [p.split(":") for p in x.found.split(",") if p]
        assert found == sorted(found, key=lambda p: (int(p[1]), pii.KINDS.index(p[0])))
        want, at = "", 0
        for k, s, e in ((k, int(s), int(e)) for k, s, e in found):
            if s >= at:
                want += x.t[at:s] + f"[{k.upper()}]"
            at = max(at, e)
        assert x.masked == want + x.t[at:]
    by = {x.doc_id: x for x in out}
    assert by[11].found.count("secret") == 2
    assert pii.spans(docs.where("false"), pii.learn(docs.where("false"))).count() == 0


def test_native(spark):
    docs = spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string")
    plan = pii.spans(docs, pii.learn(docs)).select(pii.listed("found"), pii.masked())._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Exchange", plan)


def test_secrets_of_the_table(spark):
    d = "/root/testdata/sf0.01"
    want = {r.doc_id: re.findall(r'token = "([0-9a-f]{40})"', r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    out = pii.op7_weak_pii(spark, d).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for x in out:
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in _base(text[x.doc_id]))
        assert x.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        got = [text[x.doc_id][int(p.split(":")[1]) : int(p.split(":")[2])] for p in x.spans.split(",") if p.startswith("secret")]
        assert got == want[x.doc_id], x.doc_id


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    good = all_ = 0
    for x in classifier.op1_neighbour_vote(spark, d).collect():
        assert 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3)
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0)
        if x.held_out and x.doc_id in labels:
            good += x.predicted == labels[x.doc_id]
            all_ += 1
    assert good / all_ > 0.97, (good, all_)


def test_cases_of_the_classifier(spark):
    rows = [(i, t, 3) for i, t in enumerate([None, "", " \n", "Fine words are here and there.", "BAD!! BAD!! BAD!!", "x" * 200_000, "w " * 50_000])] + [(None, "Fine words", 3), (3, "Fine words are here and there.", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (4, 0, 0), (5, None, 0), (None, 1, 0)], "doc_id long, quality int, text int")
    out = classifier.score(docs, classifier.fit(docs, labels)).collect()
    assert len(out) == len(rows)
    by = {x.doc_id: x.score for x in out}
    assert by[3] > 0.5 > by[4] and by[0] == by[1] == by[2]
    none = classifier.fit(docs, labels.where("false"))
    assert {x.score for x in classifier.score(docs, none).collect()} == {0.5}
    assert classifier.score(docs.where("false"), none).count() == 0


def test_the_vote_equals_brute_force():
    """Cosines with every vector, the nearest VOTERS, weights to the power, then two lines."""
    r = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choice(words[30 * y : 30 * y + 40], size=r.integers(3, 60))) + "!" * (1 - y) for y in r.integers(0, 2, 90)]
    y = np.array([t[-1] != "!" for t in texts], dtype=np.int64)
    of = classifier.Features()
    model = classifier.Model(of(texts[:70]), y[:70], 0.5)
    got = model.score(of(texts[70:]))
    z, ok = model.project(of(texts[70:]))
    assert ok.all()
    for v, s in zip(z, got):
        near = sorted(((float(v @ x), int(label)) for x, label in zip(model.sample, model.label)), reverse=True)[: classifier.VOTERS]
        weights = [max(0.0, c) ** classifier.POWER for c, _ in near]
        share = sum(w * label for w, (_, label) in zip(weights, near)) / sum(weights)
        want = share / model.cut * 0.3 if share < model.cut else 0.3 + (share - model.cut) / (1 - model.cut) * 0.7
        assert abs(s - want) < 1e-4
    assert classifier.best_cut(np.array([0.1, 0.2, 0.6, 0.9]), np.array([0.0, 0, 1, 1])) == pytest.approx(0.4)
    assert classifier.best_cut(np.array([0.5, np.nan]), np.array([1.0, 0])) == classifier.CUT


def test_repeated_ids_are_learned_from_once(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "other words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (4, 0)], "doc_id long, quality int")
    model = classifier.fit(docs, labels)
    assert sorted(model.label) == [0, 1] and model.prior == 0.25

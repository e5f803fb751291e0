import random
import re
from collections import defaultdict

import pytest

from sparkloam.llm import common, jaccard, suffixes


def _components(rows, n, num):
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= num * (len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    by = defaultdict(list)
    for i in range(len(rows)):
        by[find(i)].append(rows[i][0])
    return sorted(((rows[i][0], len(sets[i]), min((x for x in by[find(i)] if x is not None), default=None)) for i in range(len(rows))), key=str)


@pytest.mark.parametrize("n,num,seed", [(3, 90, 0), (5, 80, 1), (3, 90, 2), (1, 50, 3)])
def test_components_equal_brute_force(spark, n, num, seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    texts = [None, "", " \n", "One", "one", "one two", "two one", "ONE TWO", "a b c", "a b c d"]
    shared = [r.choice(vocab) for _ in range(40)]
    for _ in range(25):
        base = [r.choice(vocab) for _ in range(r.randrange(5, 120))]
        if r.random() < 0.4:
            base += shared
        for _ in range(r.choice([1, 1, 2, 3, 9])):
            own = list(base)
            for _ in range(r.randrange(4)):
                own[r.randrange(len(own))] = r.choice(vocab)
            texts.append(r.choice([" ", "\t", "\n"]).join(own))
    rows = list(enumerate(texts)) + [(7, texts[20]), (None, texts[20]), (15, texts[15])]
    r.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x", b"k") for i, t in rows], "doc_id long, text string, n string, key binary")
    got = jaccard.join(docs, n=n, num=num).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=str) == _components(rows, n, num)


def test_no_rows_and_one_large_group(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join(docs).count() == 0
    base = [f"v{i}" for i in range(100)]
    rows = [(i, " ".join(base[: i % 60] + [f"x{i}"] + base[i % 60 + 1 :])) for i in range(1, 150)] + [(0, " ".join(base))]
    out = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), n=3, num=90).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in out), key=str) == _components(rows, 3, 90)


def _removed(texts, size):
    seen = defaultdict(int)
    raw = [(t or "").encode() for t in texts]
    for t in raw:
        for i in range(len(t) - size + 1):
            seen[t[i : i + size]] += 1
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        spans = [m.span() for m in re.finditer(b"\1+", gone)]
        out.append((len(t), spans, bytes(c for c, g in zip(t, gone) if not g)))
    return out


@pytest.mark.parametrize("size,dictionary,seed", [(40, 512, 0), (40, 1, 1), (33, 2, 2), (400, 512, 3), (64, 3, 4), (20, 512, 5)])
def test_removal_equals_brute_force(spark, size, dictionary, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(r.randrange(2, size // 3))) for _ in range(6)]
    texts = [None, "", "short", "a" * (3 * size), "ab" * (2 * size), "é" * size, "xyz" * size + "q" + "xyz" * size]
    for _ in range(30):
        parts = [" ".join(word() for _ in range(r.randrange(1, 40))) for _ in range(r.randrange(1, 5))]
        for _ in range(r.randrange(3)):
            parts.insert(r.randrange(len(parts) + 1), r.choice(passages))
        texts.append(" ".join(parts))
    texts += [texts[10], texts[11], texts[11][5:], texts[12] + texts[13]]
    rows = list(enumerate(texts)) + [(9, texts[9]), (None, texts[14])]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, kh int, raw string")
    got = suffixes.dedup(docs, size=size, dictionary=dictionary).collect()
    want = _removed([t for _, t in rows], size)
    assert sorted(((x.doc_id, x.n_bytes, [(s.s, s.e) for s in x.spans], bytes(x.kept)) for x in got), key=str) == sorted(((i, *w) for (i, _), w in zip(rows, want)), key=str)


@pytest.mark.parametrize("size,coarse,hot,seed", [(40, 20, 1, 6), (64, 50, 3, 7), (100, 40, 50_000, 8)])
def test_fine_ranges_lie_in_coarse_ones(spark, monkeypatch, size, coarse, hot, seed):
    """Both sizes as by brute force, with frequent phrases marked and pieces of long texts."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "FEW", 2)
    monkeypatch.setattr(suffixes, "CHUNK", 150)
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 9)))
    common = " ".join(word() for _ in range(size // 2))
    texts = [None, "", "short", "a" * (3 * size), "é" * size, "xyz" * size + "q" + "xyz" * size]
    for i in range(30):
        own = [" ".join(word() for _ in range(r.randrange(1, 30))) for _ in range(3)]
        texts.append(own[0] + common[: r.randrange(len(common))] + own[1] + common * (i % 3 > 0) + own[2])
    texts += [texts[8], texts[9][3:]]
    rows = list(enumerate(texts)) + [(9, texts[9]), (None, texts[10]), (None, texts[11])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, rk int")
    got = suffixes.dedup(docs, size=size, coarse=coarse).collect()
    fine, wide = _removed([t for _, t in rows], size), _removed([t for _, t in rows], coarse)
    want = [(i, n, spans, kept, sum(e - s for s, e in w)) for (i, _), (n, spans, kept), (_, w, _) in zip(rows, fine, wide)]
    assert sorted(((x.doc_id, x.n_bytes, [(s.s, s.e) for s in x.spans], bytes(x.kept), x.n_coarse) for x in got), key=str) == sorted(want, key=str)


def test_nothing_to_remove(spark):
    assert suffixes.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    x = suffixes.dedup(spark.createDataFrame([(1, "q" * 500)], "doc_id long, text string")).first()
    assert [(s.s, s.e) for s in x.spans] == [(0, 500)] and x.kept == b""


def test_tables_are_stored_without_processes_for_checksums(spark):
    from pathlib import Path

    table = common.stored(spark.range(100).repartition(3), "t")
    names = {p.name for p in Path(re.sub("^file:/*", "/", table._stored_at)).iterdir()}
    assert "_SUCCESS" in names and not any(n.endswith(".crc") for n in names)
    assert sorted(r.id for r in table.collect()) == list(range(100))
    common.discard(table)
    assert not Path(re.sub("^file:/*", "/", table._stored_at)).exists()


def test_no_process_is_started_to_store_a_table(spark, tmp_path):
    from pathlib import Path

    jvm = spark._jvm
    common.discard(common.stored(spark.range(1), "t"))  # from now on its class is there
    record = jvm.jdk.jfr.Recording()
    record.enable("jdk.ProcessStart")
    record.start()
    table = common.stored(spark.range(100).repartition(3), "t")
    record.stop()
    record.dump(jvm.java.nio.file.Paths.get(str(tmp_path), spark.sparkContext._gateway.new_array(jvm.String, 0)).resolve("starts.jfr"))
    started = [str(e.getString("command")) for e in jvm.jdk.jfr.consumer.RecordingFile.readAllEvents(jvm.java.nio.file.Paths.get(str(tmp_path / "starts.jfr"), spark.sparkContext._gateway.new_array(jvm.String, 0)))]
    assert not [x for x in started if table._stored_at.rpartition("/")[2] in x]
    folder = Path(re.sub("^file:/*", "/", table._stored_at))
    plain = tmp_path / "plain"
    spark.range(1).write.parquet(str(plain))
    mode = lambda top, of: {p.stat().st_mode for p in top.glob(of)}
    assert mode(folder, "*.parquet") == mode(plain, "*.parquet") and folder.stat().st_mode == plain.stat().st_mode
    assert sorted(r.id for r in table.collect()) == list(range(100))
    common.discard(table)

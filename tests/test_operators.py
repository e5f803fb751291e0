import bz2
import random
import time

import pytest
from pyspark.sql import functions as F

from sparkloam import queries
from sparkloam.operators import clustering, graph, sorting, tuning
from sparkloam.plans import arithmetic
from sparkloam.sources import files
from sparkloam.streaming import limits

#: Ranks of the toy graph after three iterations, and where it stops.
TOY = [0.127777778, 0.177777778, 0.194444444, 0.233333333, 0.266666667]


def test_toy_graph(spark):
    edges = spark.createDataFrame(queries.TOY + [(0, 1)], "src long, dst long")
    ranks, errors = graph.pagerank(edges, 5, iterations=3)
    assert [r.rank for r in ranks.orderBy("node").collect()] == pytest.approx(TOY, abs=1e-9)
    assert errors == pytest.approx([0.2, 0.139443338, 0.132637071], abs=1e-9)
    ranks, errors = graph.pagerank(edges, 5)
    assert len(errors) == 24 and errors[-1] == pytest.approx(3.2985e-05, abs=1e-9)
    assert ranks.agg(F.sum("rank")).first()[0] == pytest.approx(1)


@pytest.mark.parametrize("n", [0, 1, 5, 300])
def test_sort_keeps_rows_and_order(spark, n):
    r = random.Random(n)
    rows = [(i, r.choice("abcé") * r.randrange(1, 4)) for i in range(n)]
    df = spark.createDataFrame(rows, "i long, key string")
    got = [(x.i, x.key) for x in sorting.ranked(df, ["key", "i"]).orderBy("rank").collect()]
    assert got == sorted(rows, key=lambda x: (x[1].encode(), x[0]))
    out = sorting.total_sort(df, "key", 4, ("i",))
    parts = out.withColumn("p", F.spark_partition_id()).collect()
    assert sorted((x.i, x.key) for x in parts) == sorted(rows)
    assert all(x.p == x.bucket for x in parts)
    assert sum(x.unsorted for x in sorting.unsorted_pairs(out, "key", ("i",)).collect()) == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 17])
def test_bucket_counts_lesser_bounds(spark, n):
    limits = sorted(random.Random(n).choices("abcdefgh", k=n))  # with repeats
    keys = ["", "a", "b", "bb", "d", "h", "z"]
    df = spark.createDataFrame([(k,) for k in keys], "key string").select("key", sorting.bucket("key", limits).alias("b"))
    assert {r.key: r.b for r in df.collect()} == {k: sum(x < k for x in limits) for k in keys}


def test_null_keys_are_left_out(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "i long, key string")
    assert {x.i for x in sorting.with_buckets(df, "key", 2).collect()} == {1, 3}


def test_kmeans(spark):
    points = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [10.0, 0.0]), (3, [10.0, 2.0])], "id long, v array<double>")
    centroids, moves = clustering.lloyd(points, 2, 3)
    assert centroids[1] == [0.0, 0.0]  # the first two points are equal: the second cluster stays empty
    assert moves[0] == (1, 4, 1.0)
    centroids, moves = clustering.lloyd(points, 2, 5, [[0.0, 0.0], [9.0, 0.0]], threshold=0.0)
    assert centroids == [[0.0, 0.0], [10.0, 1.0]] and len(moves) == 2
    assert clustering.lloyd(points.where("false"), 2, 3) == ([], [])


def test_splits_cover_once(spark):
    for size, parts in ((1000, 7), (999, 4), (10, 8)):
        spans = [(r.first, r.last) for r in arithmetic.fixed_splits(spark, size, 10, parts).orderBy("part").collect()]
        assert spans[0][0] == 0 and spans[-1][1] == size and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    with pytest.raises(ValueError):
        arithmetic.shards(spark, 10, 3)


def test_files(spark, tmp_path):
    (tmp_path / "edges").mkdir()
    (tmp_path / "edges/part-00000").write_text("0\t1\n0\t3\n")
    assert sorted(map(tuple, files.read_edges(spark, f"{tmp_path}/edges").collect())) == [(0, 1), (0, 3)]
    (tmp_path / "points").write_text("1.5, 2\n3,x\n-1,4\n")
    assert sorted(r.v for r in files.read_points(spark, f"{tmp_path}/points", 2).collect()) == [[-1.0, 4.0], [1.5, 2.0]]
    (tmp_path / "fixed").write_text("abc123\ndef456\n")
    assert [tuple(r) for r in files.read_fixed(spark, f"{tmp_path}/fixed", {"k": 3, "v": 3}).collect()] == [("abc", "123"), ("def", "456")]
    (tmp_path / "lines.bz2").write_bytes(bz2.compress(b"__label__2 Good one\n__label__1 Bad\n"))
    assert [(r.y, r.x) for r in tuning.parse_lines(files.read_lines(spark, f"{tmp_path}/lines.bz2")).collect()] == [(1, "Good one"), (0, "Bad")]
    df = spark.createDataFrame([('a"b', 1), ("c", 2)], "k string, v int")
    files.write_delimited(df, f"{tmp_path}/out", ";")
    assert sorted(map(tuple, files.read_delimited(spark, f"{tmp_path}/out", "k string, v int", ";").collect())) == [('a"b', 1), ("c", 2)]
    files.append_records(df, f"{tmp_path}/log")
    files.append_records(df, f"{tmp_path}/log")
    assert spark.read.csv(f"{tmp_path}/log", header=True).count() == 4
    files.write_shards(df, f"{tmp_path}/shards", "v")
    assert spark.read.json(f"{tmp_path}/shards").count() == 2
    assert files.object_sizes(spark, f"{tmp_path}/fixed").first()["length"] == 14


def _reviews(spark, n):
    return spark.createDataFrame([(i, i % 2, ("good fine nice" if i % 2 else "bad poor sad") + f" word{i}") for i in range(n)], "doc_id long, y int, x string")


def test_search_over_all_parameters(spark):
    rows = tuning.folds(_reviews(spark, 60), "doc_id")
    values = {"norm": ["l1", "l2"], "ngram": [1, 2], "alpha": [1e-2, 1e-4], "max_iter": [2, 10], "penalty": ["l2", "l1", "elasticnet"]}
    for shard in (512, 20):
        out = tuning.search_grid(rows, values, features=1 << 12, shard=shard).collect()
        assert sorted(tuple(r)[:5] for r in out) == sorted(tuple(r) for r in tuning.grid(spark, values).collect())
        assert max(r.accuracy for r in out) > 0.9
    best = tuning.best_of(spark.createDataFrame(out)).first()
    assert best.accuracy == max(r.accuracy for r in out)
    assert tuning.search_grid(rows.where("false"), values).count() == 0


def test_registered_search_is_the_whole_grid(spark):
    found = queries.QUERIES["grid_search"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(tuple(r)[:5] for r in found) == sorted(map(tuple, tuning.grid(spark).collect())) and len(found) == 192
    assert max(r.accuracy for r in found) > 0.9


def _plain_search(rows, values, features):
    """Right answers by combination: the same, from the definition, for rows of one shard."""
    import hashlib
    import re

    import numpy as np

    good, rows = {}, sorted(rows)
    y, fold = np.array([2 * r[1] - 1 for r in rows]), np.array([r[3] for r in rows])
    for norm in values["norm"]:
        for ngram in values["ngram"]:
            x = []
            for r in rows:
                w = re.findall("[a-z0-9_][a-z0-9_]+", (r[2] or "").lower())
                terms = w + [f"{a} {b}" for a, b in zip(w, w[1:])] * (ngram == 2)
                at, n = np.unique(np.array([int(hashlib.md5(t.encode()).hexdigest()[:5], 16) % features for t in terms], dtype=int), return_counts=True)
                x.append((at, n / (n.sum() if norm == "l1" else np.sqrt((n * n).sum()))))
            for alpha in values["alpha"]:
                for penalty in values["penalty"]:
                    for k in range(5):
                        train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
                        for stop, (w, b) in zip(values["max_iter"], tuning.hinge_path([x[i] for i in train], y[train], features, alpha, tuning.NETS[penalty], values["max_iter"])):
                            key = (norm, ngram, alpha, stop, penalty)
                            good[key] = good.get(key, 0) + sum((w[x[i][0]] @ x[i][1] + b > 0) == (y[i] > 0) for i in test)
    return good


def test_search_is_that_of_the_definition(spark):
    r = random.Random(4)
    text = lambda y: " ".join(r.choice(["good", "fine", "one two", "Two_3", "x"] if y and r.random() < 0.7 else ["bad", "sad", "one", "two", f"w{r.randrange(90)}"]) for _ in range(r.randrange(1, 30)))
    rows = [(i, int(i % 3 > 0), text(i % 3), i % 5) for i in range(120)] + [(200, 1, "", 0), (201, 0, None, 1), (202, 1, "one", 2)]
    df = spark.createDataFrame(rows, "doc_id long, y int, x string, fold int")
    values = {"norm": ["l1", "l2"], "ngram": [1, 2], "alpha": [1e-2, 1e-4], "max_iter": [3, 12], "penalty": ["l2", "l1", "elasticnet"]}
    for features in (1 << 18, 64):
        want = _plain_search(rows, values, features)
        got = {tuple(x)[:5]: x.accuracy * len(rows) for x in tuning.search_grid(df, values, features=features).collect()}
        assert got.keys() == want.keys()
        assert got == pytest.approx(want)


@pytest.mark.parametrize("name", ["grid_search", "grid_search_best"])
def test_the_whole_grid_takes_seconds(spark, name):
    """3,980 rows; each step of a descent in Python took minutes."""
    began = time.time()
    assert max(r.accuracy for r in queries.QUERIES[name](spark, "/root/testdata/sf0.1").collect()) > 0.85
    assert time.time() - began < 40


def test_models_learn_from_the_rows_of_all_blocks(spark):
    """Each row's word stands in one other row, mostly of another block: a model that is trained on its
    own block alone doesn't know it."""
    names = [f"{'good' if y else 'bad'}{w}" for w in range(150) for y in (0, 1)]
    rows = [(i, i % 2, f"{names[i % 300]} the", i // 300 * 2) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, y int, x string, fold int")
    values = {"norm": ["l2"], "ngram": [1], "alpha": [1e-4], "max_iter": [20], "penalty": ["l2"]}
    for shard in (1000, 30):
        assert tuning.search_grid(df, values, shard=shard).first().accuracy > 0.95


def test_best_of_the_registered_search_learns_from_all_blocks(spark, tmp_path):
    """2,000 rows are four blocks, and each row's word stands in one other row."""
    # The folds are runs of 200 ids a label: the two rows of a word are in different ones.
    df = spark.createDataFrame([(i, i % 2, f"{'good' if i % 2 else 'bad'}{i % 1000} the") for i in range(2000)], "doc_id long, quality int, text string")
    df.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    df.select("doc_id", "quality").write.parquet(f"{tmp_path}/labels.parquet")
    assert queries.QUERIES["grid_search_best"](spark, str(tmp_path)).first().accuracy > 0.95


def test_search_over_blocks_is_that_of_the_definition(spark, monkeypatch):
    import numpy as np

    r = random.Random(6)
    texts = [" ".join(r.choice(["good", "fine", f"g{r.randrange(40)}"] if i % 2 and r.random() < 0.6 else ["bad", "sad", f"w{r.randrange(60)}"]) for _ in range(r.randrange(1, 12))) for i in range(150)]
    texts[7] = "good " * 9000  # a count of more than one entry
    rows = [(i, i % 2, texts[i], i % 5) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, y int, x string, fold int")
    values = {"norm": ["l1", "l2"], "ngram": [1, 2], "alpha": [1e-2, 1e-4], "max_iter": [3, 40], "penalty": ["l2", "l1", "elasticnet"]}
    shards = -(-len(rows) // 20)
    block = np.array([x.b for x in df.orderBy("doc_id").select(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("b")).collect()])
    fold, path, calls = np.arange(150) % 5, tuning.hinge_path, []

    def by_blocks(x, y, *args):
        train = np.flatnonzero(fold != len(calls) % 5)
        calls.append(len(train))
        return path(x, y, *args, blocks=[np.flatnonzero(block[train] == b) for b in np.unique(block)])

    monkeypatch.setattr(tuning, "hinge_path", by_blocks)
    for features in (1 << 18, 64):
        want = _plain_search(rows, values, features)
        got = {tuple(x)[:5]: x.accuracy * len(rows) for x in tuning.search_grid(df, values, features=features, shard=20).collect()}
        assert got == pytest.approx(want)


def test_packed_rows_hold_the_hashed_terms(spark):
    import numpy as np
    import pyarrow as pa

    docs = [(0, "a1 b2 a1 c3 dd zz"), (1, ""), (2, "zz b2 qq qq qq rr"), (3, None), (4, "b2")]
    words = pa.array([(t or "").split() if t is not None else None for _, t in docs], pa.list_(pa.string()))
    df = spark.createDataFrame(docs, "i long, x string")
    for ngram, row, bucket, n in tuning.hashed_rows(words, 1 << 12, [1, 2]):
        want = {(x.id, x.bucket): x.value for x in tuning.hashed_terms(df, "i", "x", features=1 << 12, ngram=ngram, norm=None).collect()}
        assert dict(zip(zip(row.tolist(), bucket.tolist()), n.tolist())) == want
        r, at, m, copies = tuning.merged(row, bucket, n)
        assert copies.sum() == len({*bucket.tolist()}) and len(copies) == at.max() + 1 < copies.sum()
        assert np.bincount(r, m**2 * copies[at], 5) == pytest.approx(np.bincount(row, n**2, 5))


def test_descent(spark):
    import numpy as np

    r = np.random.default_rng(0)
    true = np.array([2.0, -1.0, 0.0, 0.0, 0.0])
    x = r.normal(size=(300, 5))
    y = np.sign(x @ true)
    rows = [(np.arange(5), v) for v in x]
    for net in (0.0, 0.15, 1.0):
        (w, b), (w2, _) = tuning.hinge_path(rows, y, 5, 1e-2, net, [1, 30])
        assert np.mean(np.sign(x @ w2 + b) == y) > 0.95
    # A strong absolute penalty leaves only what matters.
    ((w, _),) = tuning.hinge_path(rows, y, 5, 0.1, 1.0, [30])
    assert np.all(np.abs(w[2:]) < 0.05) and abs(w[0]) > 0.3


def test_terms(spark):
    docs = spark.createDataFrame([(1, "Ab ab, cd! e"), (2, ""), (3, None)], "i long, x string")
    one, two = (tuning.hashed_terms(docs, "i", "x", ngram=n, norm="l1").collect() for n in (1, 2))
    assert sorted(r.value for r in one) == pytest.approx([1 / 3, 2 / 3]) and len(two) == 4
    assert sum(r.value**2 for r in tuning.hashed_terms(docs, "i", "x").collect()) == pytest.approx(1)


def test_permits_of_a_stream(spark, tmp_path):
    rows = [(i, 1_700_000_000 + i // 4) for i in range(20)]
    spark.createDataFrame(rows, "event_id long, s long").select("event_id", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("event_id long, ts timestamp").parquet(f"{tmp_path}/in")
    q = limits.admitted_stream(stream, "1 second", 2).writeStream.format("memory").queryName("permits").outputMode("append").start()
    began = time.time()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT window_start, count(*) AS n FROM permits GROUP BY 1").collect()
    assert [r.n for r in got] == [2] * 5 and time.time() - began < 120


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.count() > 0 and out.columns == ["o_orderkey", "key", "rank"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

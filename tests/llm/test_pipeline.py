from collections import defaultdict

import corpus_pipeline
from pyspark.sql import functions as F

import __spark_entry__


def test_stages_take_effect(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    more = spark.createDataFrame([(-1, "Call +1 (017) 555-7713 now, says the good neighbour of all the people in the town.", "en", "s", 0), (None, None, None, None, None), (-2, "", "en", "s", 0)], docs.schema)
    docs = docs.unionByName(more).withColumn("extra", F.lit("x"))
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], d)
        out.write.parquet(f"{tmp_path}/{name}")
        seen.append(spark.read.parquet(f"{tmp_path}/{name}"))
    assert all(x.columns == docs.columns for x in seen[:-1])
    sizes = [x.count() for x in seen]
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] == sizes[4]
    texts = [{r.doc_id: r.text for r in x.collect()} for x in seen[:-1]]
    assert "[PHONE]" in texts[4][-1] and None in texts[4] and texts[4][-2] == ""
    assert sum(len(t or "") for t in texts[3].values()) < sum(len(t or "") for t in texts[2].values())
    bins = defaultdict(int)
    for r in seen[-1].collect():
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 2048 and {r.doc_id for r in seen[-1].select("doc_id").distinct().collect()} == set(texts[4])


def test_rows_without_words_stay(spark):
    text = "one two three four five six seven"
    rows = [(None, None, "a"), (None, None, "b"), (None, "", "a"), (None, " \t\x0b", "a"), (3, "", "a"), (3, "", "a"), (4, text, "a"), (4, text, "a"), (5, text, "b"), (6, "word", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, rows[:7] + rows[9:]))


def test_registered(spark):
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0


CLASH = ("_text", "score", "kept_rk", "kept_id", "_rk", "rk", "rest", "row", "t", "base", "found", "key", "spans", "s", "own")


def test_clashing_columns_keep_their_values(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, "en", *range(len(CLASH))), (2, text, "en", *range(len(CLASH))), (3, "Call +1 (017) 555-7713 now, says the neighbour.", "en", *range(10, 10 + len(CLASH))), (None, None, None, *[None] * len(CLASH))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"`{c}` int" for c in CLASH))
    spark.createDataFrame([(3, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        want = {r.doc_id: tuple(r)[3:] for r in docs.collect()}
        assert all(tuple(r)[3:] == want[r.doc_id] for r in out.collect())
    assert corpus_pipeline.packed(spark, docs, str(tmp_path)).count() == 4


def test_empty_table_and_a_very_long_text(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for rows, n in ((docs.where("false"), 0), (docs.limit(1).withColumn("text", F.expr("concat_ws(' ', transform(sequence(1, 150000), i -> concat('w', i)))")), 1)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows_out = stage(spark, rows, d)
            assert rows_out.columns == docs.columns and rows_out.count() in (0, n)
        assert (corpus_pipeline.packed(spark, rows, d).count() > 0) == (n > 0)


def test_unrelated_texts_that_share_an_id_or_have_none_stay(spark):
    texts = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcd"]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[3])]
    got = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, rows[:4]))

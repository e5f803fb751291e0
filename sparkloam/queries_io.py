"""Named queries over sources, sinks and the smaller operators: each writes to the shared
folder what it reads back, so that its rows can be held against SQL over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .functions import frames
from .operators import collectives, sorting, tuning
from .plans import arithmetic
from .queries import BOUNDS, BUCKETS, GROUP, KEYS, LINES, P, RAW, ST, STAMPS, WORKERS, _edges, _keyed, _lines, _stamps, query
from .session import shared_dir, table
from .sources import files


def _path(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Sources --------------------------------------------------------------------------------
@query(f"WITH {KEYS} SELECT o_orderkey, key, o_orderstatus FROM k")
def scan_delimited(spark, d):
    path = _path(spark, "delimited")
    files.write_delimited(_keyed(spark, d), path)
    return files.read_delimited(spark, path, "o_orderkey long, key string, o_orderstatus string")


@query(f"WITH {KEYS} SELECT o_orderkey, key FROM k WHERE o_orderkey % 10 <> 0")
def scan_bad_lines(spark, d):
    """Every tenth line has text where a number should be; such lines are skipped."""
    path = _path(spark, "fragments")
    rows = _keyed(spark, d).select(F.when(F.col("o_orderkey") % 10 == 0, F.lit("bad")).otherwise(F.col("o_orderkey").cast("string")).alias("n"), "key")
    files.write_delimited(rows, path, ";")
    return files.read_delimited(spark, path, "o_orderkey long, key string", ";", strict=False)


@query(f"WITH {KEYS}, o AS (SELECT key, (row_number() OVER (ORDER BY o_orderkey) - 1) * 11 AS pos FROM k), p AS (SELECT id AS part, least(id * 11 * c, 11 * n) AS first, least((id + 1) * 11 * c, 11 * n) AS last FROM range({P}) t(id), (SELECT count(*) AS n, (count(*) + {P - 1}) // {P} AS c FROM k)) SELECT part, count(*) AS n, min(key) AS low, max(key) AS high FROM o JOIN p ON pos >= first AND pos < last GROUP BY part")
def scan_split_rows(spark, d):
    """Which rows of a file of fixed rows each split reads: those that start in it."""
    rows = sorting.ranked(_keyed(spark, d).select("o_orderkey", "key"), ["o_orderkey"]).withColumn("at", F.col("rank") * 11)
    plan = arithmetic.fixed_splits(spark, rows.count() * 11, 11, P)
    return arithmetic.rows_of_splits(rows, plan, "at").groupBy("part").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))


@query(f"WITH {KEYS}, o AS (SELECT key, (row_number() OVER (ORDER BY o_orderkey) - 1) * 11 AS pos FROM k), s AS (SELECT count(*) * 11 AS size FROM k), p AS (SELECT id AS worker, CASE WHEN id = 0 THEN 0 ELSE (size // {GROUP}) * id + 1 END AS first, CASE WHEN id = {GROUP - 1} THEN size ELSE (size // {GROUP}) * (id + 1) END AS last FROM range({GROUP}) t(id), s) SELECT worker, count(*) AS n, min(key) AS low, max(key) AS high FROM o JOIN p ON pos >= first AND pos <= last GROUP BY worker")
def scan_offset_rows(spark, d):
    """The same by explicit, inclusive offsets."""
    rows = sorting.ranked(_keyed(spark, d).select("o_orderkey", "key"), ["o_orderkey"]).withColumn("at", F.col("rank") * 11)
    plan = arithmetic.gather_splits(spark, rows.count() * 11, GROUP, GROUP).select("worker", "first", (F.col("last") + 1).alias("last"))
    return arithmetic.rows_of_splits(rows, plan, "at").groupBy("worker").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))


@query(f"WITH {RAW} SELECT src, count(DISTINCT dst) AS outdegree, min(dst) AS first, max(dst) AS last FROM w GROUP BY src")
def scan_edges(spark, d):
    path = _path(spark, "edges")
    files.write_delimited(_edges(spark, d)[0], path, "\t")
    return files.read_edges(spark, path).groupBy("src").agg(F.count_distinct("dst").alias("outdegree"), F.min("dst").alias("first"), F.max("dst").alias("last"))


@query("SELECT vec_id AS id, len(embedding) AS dims, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
def scan_points(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    dims, path = rows.agg(F.max(F.size("v"))).first()[0] or 0, _path(spark, "points")
    files.write_delimited(rows.select("id", *[F.col("v")[i].alias(f"c{i}") for i in range(dims)]), path)
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return files.read_points(spark, path, dims, with_id=True).select("id", F.size("v").alias("dims"), F.round(total, 5).alias("total"))


@query("SELECT r_regionkey AS region, sum(length(n_name) + 1)::BIGINT AS bytes, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def scan_whole_objects(spark, d):
    """One object a region, read whole; its size from the object's status."""
    path = _path(spark, "objects")
    rows = table(spark, d, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("value"))
    rows.repartition("region").write.partitionBy("region").text(path)
    whole = files.read_whole(spark, f"{path}/*/").join(files.object_sizes(spark, f"{path}/*/"), "path")
    names = F.array_join(F.array_sort(F.split(F.rtrim(F.col("value"), F.lit("\n")), "\n")), ",")
    return whole.select(F.regexp_extract("path", "region=([0-9]+)", 1).cast("int").alias("region"), F.col("length").alias("bytes"), names.alias("names"))


@query(f"SELECT id AS worker, 1024 AS bytes, md5(repeat('x', 1024)) AS digest FROM range({WORKERS}) t(id)")
def synthetic_payload(spark, d):
    rows = files.synthetic(spark, WORKERS, 1024)
    return rows.select("worker", F.octet_length("data").alias("bytes"), F.md5("data").alias("digest"))


@query(f"SELECT id AS partition_idx, id // {GROUP} AS shard, 'sort/input' AS key, id * 1000 AS first, ['b' || id, 'c' || id] AS segment_bounds, 'us-east-1' AS region FROM range({WORKERS}) t(id)")
def payload_json(spark, d):
    path = _path(spark, "payload")
    store = F.struct(F.lit("us-east-1").alias("region"), F.lit("http://localhost:9000").alias("endpoint"))
    i = F.col("payload")
    rows = arithmetic.shards(spark, WORKERS, WORKERS // GROUP).select("shard", i.alias("partition_idx"), F.lit("sort/input").alias("key"), (i * 1000).alias("first"), F.array(F.concat(F.lit("b"), i.cast("string")), F.concat(F.lit("c"), i.cast("string"))).alias("segment_bounds"), store.alias("s3_config"))
    files.write_shards(rows, path, "shard")
    schema = "partition_idx long, key string, first long, segment_bounds array<string>, s3_config struct<region:string,endpoint:string>, shard long"
    return files.read_json(spark, path, schema).select("partition_idx", "shard", "key", "first", "segment_bounds", "s3_config.region")


# Sinks ----------------------------------------------------------------------------------
@query(f"WITH {BUCKETS} SELECT bucket AS part, count(*) AS n, min(key) AS low, max(key) AS high FROM x GROUP BY bucket")
def sink_sorted_parts(spark, d):
    """Part files whose order of names is the order of keys; rows by the number of the file."""
    path = _path(spark, "sorted")
    out = sorting.total_sort(_keyed(spark, d), "key", P, ("o_orderkey",))
    files.write_delimited(out.select("key", "o_orderkey"), path)
    back = files.read_delimited(spark, path, "key string, o_orderkey long").withColumn("part", F.regexp_extract(F.input_file_name(), "part-([0-9]+)", 1).cast("int"))
    return back.groupBy("part").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))


@query(f"WITH {ST} SELECT fn_id, a AS init_fn, b AS post_download, c AS pre_shuffle, d AS post_shuffle, e AS end_fn FROM s")
def sink_phase_csv(spark, d):
    path = _path(spark, "phases")
    files.append_records(_stamps(spark, d), path)
    return spark.read.csv(path, header=True, schema="fn_id long, " + ", ".join(f"{s} long" for s in STAMPS))


@query(f"WITH {ST} SELECT fn_id, unnest(['init_fn', 'end_fn']) AS phase, unnest([a, e]) AS ms FROM s")
def sink_phase_json(spark, d):
    """Stamps as a list of keys and values, both text."""
    path = _path(spark, "stamps")
    pairs = F.array(*[F.struct(F.lit(s).alias("key"), F.col(s).cast("string").alias("value")) for s in ("init_fn", "end_fn")])
    _stamps(spark, d).select("fn_id", pairs.alias("timestamps")).write.json(path)
    back = files.read_json(spark, path, "fn_id long, timestamps array<struct<key:string,value:string>>")
    return back.select("fn_id", F.explode("timestamps").alias("t")).select("fn_id", F.col("t.key").alias("phase"), F.col("t.value").cast("long").alias("ms"))


@query(f"WITH {BUCKETS}, z AS (SELECT o_orderkey % 4 AS map_idx, bucket, sum(length(key) + length(o_orderstatus) + 2)::BIGINT AS bytes FROM x GROUP BY 1, 2) SELECT map_idx, bucket, bytes, sum(bytes) OVER (PARTITION BY map_idx)::BIGINT AS input FROM z")
def sink_size_matrix(spark, d):
    """Bytes by bucket as a map for each input, as JSON text and back."""
    path = _path(spark, "sizes")
    size = (F.length("key") + F.length("o_orderstatus") + 2).cast("long")
    rows = sorting.with_buckets(_keyed(spark, d), "key", P).groupBy((F.col("o_orderkey") % 4).alias("map_idx"), "bucket").agg(F.sum(size).alias("bytes"))
    frames.size_maps(rows, "map_idx", "bucket", "bytes").write.json(path)
    back = files.read_json(spark, path, "map_idx long, input_partition_size long, output_partition_sizes map<string,long>")
    return back.select("map_idx", F.explode("output_partition_sizes").alias("b", "bytes"), F.col("input_partition_size").alias("input")).select("map_idx", F.col("b").cast("int").alias("bucket"), "bytes", "input")


# Rows, columns, lookups -----------------------------------------------------------------
@query(f"WITH {KEYS} SELECT o_orderstatus AS value, count(*) AS n FROM k GROUP BY 1")
def column_by_ordinal(spark, d):
    return frames.column(_keyed(spark, d), 2).groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id FROM events WHERE value IS NOT NULL")
def filter_present(spark, d):
    return frames.present(table(spark, d, "events"), "value").select("event_id", "user_id")


@query("SELECT event_id, event_type, value FROM events WHERE event_id % 97 = 5")
def lookup_results(spark, d):
    """Results of the wanted invocations."""
    wanted = table(spark, d, "events").where(F.col("event_id") % 97 == 5).select("event_id")
    return frames.lookup(table(spark, d, "events").select("event_id", "event_type", "value"), wanted, "event_id")


@query("WITH a AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS rn FROM nation), b AS (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) AS rn FROM supplier) SELECT n_name, s_name FROM a JOIN b USING (rn)")
def zip_by_order(spark, d):
    """The i-th nation with the i-th supplier."""
    return frames.zipped(table(spark, d, "nation"), ["n_nationkey"], table(spark, d, "supplier"), ["s_suppkey"]).select("n_name", "s_name")


@query(f"WITH {BUCKETS} SELECT o_orderkey, bucket FROM x")
def range_join_buckets(spark, d):
    """Buckets by a join of keys to ranges, for more bounds than an expression should hold."""
    rows = _keyed(spark, d)
    return sorting.range_buckets(rows, "key", sorting.bounds(rows, "key", P)).select("o_orderkey", "bucket")


# Planning, scalars, JSON ----------------------------------------------------------------
@query("SELECT workers, granularity, 20.0::DOUBLE / (workers / granularity) AS mib FROM (SELECT unnest([6, 24, 48]) AS workers), (SELECT unnest([1, 6]) AS granularity)")
def mib_per_worker(spark, d):
    rows = spark.createDataFrame([(w, g) for w in (6, 24, 48) for g in (1, 6)], "workers int, granularity int")
    return arithmetic.mib_share(rows, 20.0)


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' AS out FROM events")
def json_columns(spark, d):
    rows = table(spark, d, "events")
    out = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type")))
    return rows.select("event_id", F.from_json("props", "k int")["k"].alias("k"), out.alias("out"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d-%H-%M-%S') AS stamp, strftime(make_timestamp((epoch_us(ts) // 1000) * 1000), '%Y-%m-%d %H:%M:%S') AS back FROM events")
def date_formats(spark, d):
    ntz = F.col("ts").cast("timestamp_ntz")
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    back = F.expr("timestampadd(MILLISECOND, ms, TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    rows = table(spark, d, "events").select("event_id", F.date_format(ntz, "yyyy-MM-dd-HH-mm-ss").alias("stamp"), ms.alias("ms"))
    return rows.select("event_id", "stamp", F.date_format(back, "yyyy-MM-dd HH:mm:ss").alias("back"))


@query("SELECT c_custkey, TRY_CAST(substr(c_name, 10) AS INT) AS number, TRY_CAST(c_mktsegment AS FLOAT) AS bad FROM customer")
def tolerant_numbers(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.expr("try_cast(substring(c_name, 10) AS INT)").alias("number"), F.expr("try_cast(c_mktsegment AS FLOAT)").alias("bad"))


@query("WITH v AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) SELECT dim, count(*) AS n, round(sum(x::DOUBLE), 4) AS total FROM v GROUP BY dim")
def transposed_points(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "x"))
    return rows.groupBy(F.col("dim").cast("long").alias("dim")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("x").cast("double")), 4).alias("total"))


@query(f"WITH {LINES}, c AS (SELECT doc_id, y, row_number() OVER (ORDER BY doc_id) AS rn FROM x) SELECT doc_id, y FROM c WHERE rn <= 200")
def text_line_limit(spark, d):
    """The limit of lines that a text scan takes, here 200."""
    return tuning.first_lines(_lines(spark, d), ["doc_id"], 200).select("doc_id", "y")


# Functions over rows --------------------------------------------------------------------
@query("SELECT user_id % 8 AS worker, count(*) AS n, round(regr_slope(value, event_id), 9) AS slope FROM events WHERE value IS NOT NULL GROUP BY 1")
def worker_fits(spark, d):
    """A whole job a worker: each fits its own rows."""
    rows = table(spark, d, "events").where(F.col("value").isNotNull()).select((F.col("user_id") % 8).alias("worker"), F.col("event_id").cast("double").alias("x"), F.col("value").alias("y"))
    return collectives.fits(rows).withColumn("slope", F.round("slope", 9))


@query("SELECT n_nationkey AS worker, '{\"worker\":' || n_nationkey || ',\"length\":' || length(n_name) || '}' AS result FROM nation")
def action_results(spark, d):
    """An action, from JSON arguments to a JSON result, run for every row of parameters."""
    args = table(spark, d, "nation").select(F.col("n_nationkey").alias("worker"), F.to_json(F.struct(F.col("n_nationkey").alias("worker"), F.col("n_name").alias("name"))).alias("args"))
    return collectives.invoked(args, lambda a: {"worker": a["worker"], "length": len(a["name"])})

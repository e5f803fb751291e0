"""Named queries over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import metrics
from .operators import clustering, collectives, graph, sorting, tuning
from .plans import arithmetic
from .session import table
from .streaming import limits

P, WORKERS, GROUP, K = 8, 24, 6, 4
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _ms(column: str):
    """Milliseconds since 1970 of a time without a zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))")


# Sort -----------------------------------------------------------------------------------
KEY = "printf('%010d', (o_orderkey * 2654435761) % 10000000000)"
KEYS = f"k AS (SELECT o_orderkey, {KEY} AS key, o_orderstatus FROM orders)"
BOUNDS = f"{KEYS}, r AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS rn, count(*) OVER () AS n FROM k), b AS (SELECT i, key AS bound FROM r, (SELECT unnest(range(1, {P})) AS i) WHERE rn = (i * n) // {P})"
BUCKETS = f"{BOUNDS}, x AS (SELECT k.*, (SELECT count(*) FROM b WHERE bound < key) AS bucket FROM k)"


def _keyed(spark, d):
    orders = table(spark, d, "orders")
    key = F.format_string("%010d", F.pmod(F.col("o_orderkey") * F.lit(2654435761), F.lit(10_000_000_000)))
    return orders.select("o_orderkey", key.alias("key"), "o_orderstatus")


@query(f"WITH {BOUNDS} SELECT i, bound FROM b")
def sort_bounds(spark, d):
    return sorting.bounds(_keyed(spark, d), "key", P)


@query(f"WITH {BUCKETS} SELECT bucket, count(*) AS n, min(key) AS low, max(key) AS high FROM x GROUP BY bucket")
def sort_bucket_counts(spark, d):
    return sorting.with_buckets(_keyed(spark, d), "key", P).groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))


@query(f"WITH {KEYS} SELECT o_orderkey, key, row_number() OVER (ORDER BY key, o_orderkey) - 1 AS rank FROM k")
def sort_total_order(spark, d):
    return sorting.ranked(_keyed(spark, d).select("o_orderkey", "key"), ["key", "o_orderkey"])


@query(f"WITH {BUCKETS} SELECT o_orderkey % 4 AS map_idx, bucket, count(*) AS n, sum(length(key) + length(o_orderstatus) + 2)::BIGINT AS bytes FROM x GROUP BY 1, 2")
def sort_partition_sizes(spark, d):
    size = F.length("key") + F.length("o_orderstatus") + 2
    return sorting.with_buckets(_keyed(spark, d), "key", P).groupBy((F.col("o_orderkey") % 4).alias("map_idx"), "bucket").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))


@query(f"WITH {BUCKETS} SELECT bucket, count(*) AS n, 0::BIGINT AS unsorted FROM x GROUP BY bucket")
def sort_is_sorted(spark, d):
    return sorting.unsorted_pairs(sorting.total_sort(_keyed(spark, d), "key", P, ("o_orderkey",)), "key", ("o_orderkey",))


@query(f"WITH {KEYS} SELECT length(key) AS length, count(*) AS n FROM k GROUP BY 1")
def sort_row_length_check(spark, d):
    return _keyed(spark, d).groupBy(F.length("key").alias("length")).agg(F.count("*").alias("n"))


# Plans ----------------------------------------------------------------------------------
@query("SELECT id AS part, least(id * 125000, 1000000)::BIGINT AS first, least((id + 1) * 125000, 1000000)::BIGINT AS last FROM range(8) t(id)")
def split_plan_fixed(spark, d):
    return arithmetic.fixed_splits(spark, 1_000_000, 1000, P)


@query("SELECT id AS worker, (id // 6) * 6 AS base, CASE WHEN id % 6 = 0 THEN 0 ELSE 166666 * (id % 6) + 1 END::BIGINT AS first, CASE WHEN id % 6 = 5 THEN 1000000 ELSE 166666 * (id % 6 + 1) END::BIGINT AS last FROM range(24) t(id)")
def split_plan_gather(spark, d):
    return arithmetic.gather_splits(spark, 1_000_000, WORKERS, GROUP)


@query("SELECT workers, kind, greatest(1, rate // workers - 1)::BIGINT AS share FROM (SELECT unnest([1, 8, 128, 6000]) AS workers), (VALUES ('put', 5500), ('get', 3500)) v(kind, rate)")
def rate_share(spark, d):
    return arithmetic.rate_share(spark, {"put": 5500, "get": 3500}, [1, 8, 128, 6000])


@query("WITH s AS (SELECT id AS slot FROM range(2000) t(id) ORDER BY md5(id::VARCHAR) LIMIT 20) SELECT slot, slot * 4800 + 200000 AS first, (slot + 1) * 4800 + 200000 AS last FROM s")
def sample_plan(spark, d):
    return arithmetic.sample_fragments(spark, 10_000_000)


@query("SELECT id AS payload, id // 6 AS shard FROM range(24) t(id)")
def payload_shards(spark, d):
    return arithmetic.shards(spark, WORKERS, 4)


@query("SELECT id AS group_id, id * 6 AS first, (id + 1) * 6 AS last FROM range(4) t(id)")
def group_ranges(spark, d):
    return arithmetic.group_ranges(spark, WORKERS, 4)


# Graph ----------------------------------------------------------------------------------
RAW = "n AS (SELECT max(l_partkey) + 1 AS n FROM lineitem), w AS (SELECT l_partkey AS src, (l_partkey * 31 + l_suppkey * 17) % n AS dst FROM lineitem, n)"
SENT = f"{RAW}, u AS (SELECT DISTINCT src, dst FROM w), o AS (SELECT src, count(*) AS outdegree FROM u GROUP BY src), e AS MATERIALIZED (SELECT src, dst % n AS dst, outdegree FROM u JOIN o USING (src), n), r0 AS (SELECT node, 1.0::DOUBLE / n AS rank, NULL::DOUBLE AS old FROM n, (SELECT unnest(range(0, (SELECT n FROM n))) AS node))"


def _ranks(k: int) -> str:
    one = lambda i: f"r{i} AS MATERIALIZED (SELECT p.node, coalesce(s.rank, 0) AS rank, p.rank AS old FROM r{i - 1} p LEFT JOIN (SELECT dst, sum(q.rank / outdegree) AS rank FROM e JOIN r{i - 1} q ON src = q.node GROUP BY dst) s ON p.node = s.dst)"
    return f"{SENT}, " + ", ".join(one(i) for i in range(1, k + 1))


def _trace(k: int) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS iteration, sqrt(sum((rank - old) ** 2)) AS err FROM r{i}" for i in range(1, k + 1))


def _edges(spark, d):
    items = table(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    n = items.agg(F.max("l_partkey") + 1).first()[0] or 1
    return items.select(F.col("l_partkey").alias("src"), F.pmod(F.col("l_partkey") * 31 + F.col("l_suppkey") * 17, F.lit(n)).alias("dst")), n


@query(f"WITH {SENT} SELECT src, dst FROM e")
def graph_edges(spark, d):
    return graph.distinct_edges(*_edges(spark, d))


@query(f"WITH {SENT} SELECT src, outdegree FROM o")
def graph_outdegree(spark, d):
    return graph.outdegree(_edges(spark, d)[0])


@query(f"WITH {RAW} SELECT src % 4 AS part, min(src) AS first, max(src) + 1 AS last FROM w GROUP BY 1")
def graph_node_range(spark, d):
    return graph.node_ranges(_edges(spark, d)[0], 4)


@query(f"WITH {_ranks(5)} SELECT node, round(rank, 10) AS rank FROM r5")
def pagerank_fixed(spark, d):
    return graph.pagerank(*_edges(spark, d), iterations=5)[0].select("node", F.round("rank", 10).alias("rank"))


@query(f"WITH {_ranks(5)} SELECT iteration, round(err, 10) AS err FROM ({_trace(5)})")
def pagerank_error_trace(spark, d):
    errors = graph.pagerank(*_edges(spark, d), iterations=5)[1]
    return spark.createDataFrame([(i + 1, e) for i, e in enumerate(errors)], "iteration int, err double").select("iteration", F.round("err", 10).alias("err"))


@query(f"WITH {_ranks(30)}, t AS ({_trace(30)}) SELECT coalesce(min(iteration) FILTER (err < 5e-5), 30) AS iterations FROM t")
def pagerank_converged(spark, d):
    return spark.createDataFrame([(len(graph.pagerank(*_edges(spark, d))[1]),)], "iterations int")


TOY = [(0, 1), (0, 3), (1, 2), (1, 4), (2, 3), (3, 4), (4, 0), (4, 1), (4, 2)]


@query(f"WITH w AS (SELECT * FROM (VALUES {', '.join(map(str, TOY))}) v(src, dst)), n AS (SELECT 5 AS n), " + _ranks(3).removeprefix(f"{RAW}, ") + " SELECT node, round(rank, 9) AS rank FROM r3")
def pagerank_toy(spark, d):
    ranks, _ = graph.pagerank(spark.createDataFrame(TOY, "src long, dst long"), 5, iterations=3)
    return ranks.select("node", F.round("rank", 9).alias("rank"))


# K-means --------------------------------------------------------------------------------
def _lloyd(k: int) -> str:
    out = f"p AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cid, v AS c FROM (SELECT * FROM p ORDER BY id LIMIT {K})), g AS (SELECT unnest(range(1, (SELECT max(len(v)) FROM p) + 1)) AS dim)"
    for i in range(1, k + 1):
        out += f", a{i} AS MATERIALIZED (SELECT id, any_value(v) AS v, min({{'dist': x, 'cid': cid}}) AS m FROM (SELECT id, v, cid, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS x FROM p, c{i - 1}) GROUP BY id)"
        out += f", c{i} AS MATERIALIZED (SELECT cid, list(val ORDER BY dim) AS c FROM (SELECT c.cid, g.dim, coalesce(avg(a.v[g.dim]), 0) AS val FROM c0 c CROSS JOIN g LEFT JOIN a{i} a ON a.m.cid = c.cid GROUP BY ALL) GROUP BY cid)"
    return out


def _points(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


@query(f"WITH {_lloyd(1)} SELECT id, m.cid AS cid, round(m.dist, 6) AS dist FROM a1")
def kmeans_assign(spark, d):
    points = _points(spark, d)
    return clustering.assign(points, clustering.first_points(points, K)).select("id", "cid", F.round("dist", 6).alias("dist"))


@query(f"WITH {_lloyd(1)} SELECT m.cid AS cid, count(*) AS n FROM a1 GROUP BY 1")
def kmeans_sizes(spark, d):
    points = _points(spark, d)
    return clustering.assign(points, clustering.first_points(points, K)).groupBy("cid").agg(F.count("*").alias("n"))


@query(f"WITH {_lloyd(5)} SELECT cid, dim - 1 AS dim, round(c[dim], 6) AS val FROM c5, g")
def kmeans_centroids(spark, d):
    centroids, _ = clustering.lloyd(_points(spark, d), K, 5)
    rows = [(i, j, x) for i, c in enumerate(centroids) for j, x in enumerate(c)]
    return spark.createDataFrame(rows, "cid int, dim int, val double").select("cid", "dim", F.round("val", 6).alias("val"))


@query(f"WITH {_lloyd(5)} SELECT 1 AS iteration, count(*) AS moved, round(1.0::DOUBLE, 9) AS ratio FROM a1 " + " ".join(f"UNION ALL SELECT {i}, count(*) FILTER (a{i}.m.cid <> a{i - 1}.m.cid), round(count(*) FILTER (a{i}.m.cid <> a{i - 1}.m.cid) / count(*)::DOUBLE, 9) FROM a{i} JOIN a{i - 1} USING (id)" for i in range(2, 6)))
def kmeans_delta(spark, d):
    _, moves = clustering.lloyd(_points(spark, d), K, 5)
    return spark.createDataFrame(moves, "iteration int, moved long, ratio double").select("iteration", "moved", F.round("ratio", 9).alias("ratio"))


@query(f"WITH {_lloyd(4)}, z AS (SELECT id, min(list_sum(list_transform(list_zip(v, c), lambda q: (q[1] - q[2]) * (q[1] - q[2])))) AS x FROM p, c4 GROUP BY id) SELECT round(sum(x), 4) AS inertia FROM z")
def kmeans_inertia(spark, d):
    points = _points(spark, d)
    centroids, _ = clustering.lloyd(points, K, 4)
    return clustering.assign(points, centroids).agg(F.round(F.sum("dist"), 4).alias("inertia"))


# Collectives ----------------------------------------------------------------------------
W = "w AS (SELECT n_nationkey::BIGINT AS worker, n_name AS data FROM nation)"
ALL = f"{W}, m AS (SELECT b.worker, a.worker AS src, a.data || ':' || b.worker AS data FROM w a, w b)"


def _workers(spark, d):
    """Every nation is a worker; of 25 the last group is smaller, and the last has no pair."""
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("worker"), F.col("n_name").alias("data"))


def _all(spark, d):
    workers = _workers(spark, d)
    return workers, workers.count()


@query(f"WITH {W}, h AS (SELECT count(*) // 2 AS half FROM w) SELECT worker - half AS worker, worker AS src, data FROM w, h WHERE worker >= half AND worker < 2 * half")
def coll_pair(spark, d):
    return collectives.pair(*_all(spark, d))


@query(f"WITH {W} SELECT a.worker, b.worker AS src, b.data FROM w a, w b WHERE b.worker = 0")
def coll_broadcast(spark, d):
    return collectives.broadcast(_workers(spark, d), 0).select("worker", "src", "data")


@query("SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS worker, r_name AS data FROM region")
def coll_scatter(spark, d):
    items = F.transform(F.sort_array(F.collect_list(F.struct("r_regionkey", "r_name"))), lambda x: x["r_name"])
    return collectives.scatter(table(spark, d, "region").agg(items.alias("items")))


@query(f"WITH {W} SELECT count(*) AS n, string_agg(data, '|' ORDER BY worker) AS data FROM w")
def coll_gather(spark, d):
    return collectives.gather(_workers(spark, d))


@query(f"WITH {ALL} SELECT worker, src, data FROM m")
def coll_all_to_all(spark, d):
    return collectives.all_to_all(*_all(spark, d))


@query(f"WITH {W} SELECT unnest([0, 1, 2]) AS dim, unnest([sum(worker), sum(length(data)), count(*)])::BIGINT AS total FROM w")
def coll_reduce(spark, d):
    vector = F.array(F.col("worker"), F.length("data").cast("long"), F.lit(1).cast("long"))
    return collectives.reduce_sum(_workers(spark, d).withColumn("vector", vector))


@query(f"WITH {W} SELECT (worker // {GROUP}) * {GROUP} AS base, count(*) AS n, string_agg(data, '' ORDER BY worker) AS data FROM w GROUP BY 1")
def coll_group_gather(spark, d):
    return collectives.group_gather(_workers(spark, d), GROUP)


@query(f"WITH {ALL} SELECT worker, src, data, k AS round FROM m, range(2) t(k) WHERE worker <> src")
def coll_shuffle_repeat(spark, d):
    return collectives.shuffle_repeat(*_all(spark, d), 2)


@query(f"WITH {ALL} SELECT worker, count(*) AS messages, sum(strlen(data))::BIGINT AS bytes FROM m GROUP BY worker")
def coll_received(spark, d):
    return collectives.received(collectives.all_to_all(*_all(spark, d)))


@query("SELECT id::INT AS worker, 4 AS n, 6 AS total FROM range(4) t(id)")
def barrier_allgather(spark, d):
    return collectives.barrier_gather(spark, 4)


@query("SELECT id AS chunk, least(1048576, 4194305 - id * 1048576) AS bytes FROM range(5) t(id)")
def chunk_plan(spark, d):
    size, chunk = (4 << 20) + 1, 1 << 20
    return spark.range(-(-size // chunk)).select(F.col("id").alias("chunk"), F.least(F.lit(chunk), F.lit(size) - F.col("id") * chunk).alias("bytes"))


# Metrics --------------------------------------------------------------------------------
REC = "q AS (SELECT user_id % 5 AS group_id, user_id AS worker_id, value AS bytes, (epoch_us(ts) // 1000) AS s, (epoch_us(ts) // 1000) + 1000 AS e FROM events WHERE value IS NOT NULL)"


def _records(spark, d):
    ms = _ms("ts")
    rows = table(spark, d, "events").where(F.col("value").isNotNull())
    return rows.select((F.col("user_id") % 5).alias("group_id"), F.col("user_id").alias("worker_id"), F.col("value").alias("bytes"), ms.alias("start"), (ms + 1000).alias("end"))


@query(f"WITH {REC}, o AS (SELECT group_id, worker_id, sum(bytes) / 1048576 / ((max(e) - min(s)) / 1000.0) AS t FROM q GROUP BY 1, 2) SELECT group_id, count(*) AS workers, round(sum(t), 12) AS throughput FROM o GROUP BY 1")
def bench_throughput(spark, d):
    return metrics.throughput(_records(spark, d)).withColumn("throughput", F.round("throughput", 12))


@query(f"WITH {REC} SELECT group_id, round(sum(bytes) / 1048576 / ((max(e) - min(s)) / 1000.0), 12) AS bandwidth FROM q GROUP BY 1")
def bench_bandwidth(spark, d):
    return metrics.bandwidth(_records(spark, d)).withColumn("bandwidth", F.round("bandwidth", 12))


STAMPS = ["init_fn", "post_download", "pre_shuffle", "post_shuffle", "end_fn"]
ST = "s AS (SELECT o_orderkey AS fn_id, (epoch_us(o_orderdate) // 1000) AS a, (epoch_us(o_orderdate) // 1000) + o_orderkey % 97 AS b, (epoch_us(o_orderdate) // 1000) + o_orderkey % 97 + 5 AS c, (epoch_us(o_orderdate) // 1000) + o_orderkey % 97 + 5 + o_custkey % 31 AS d, (epoch_us(o_orderdate) // 1000) + o_orderkey % 97 + 9 + o_custkey % 31 AS e FROM orders)"


def _stamps(spark, d):
    t, x, y = _ms("o_orderdate"), F.col("o_orderkey") % 97, F.col("o_custkey") % 31
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("fn_id"), *[v.alias(n) for n, v in zip(STAMPS, (t, t + x, t + x + 5, t + x + 5 + y, t + x + 9 + y))])


@query(f"WITH {ST} SELECT phase, count(*) AS n, min(ms) AS least, max(ms) AS most, sum(ms)::BIGINT AS total FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS phase, {b} - {a} AS ms FROM s" for n, a, b in zip(STAMPS[1:], "abcd", "bcde")) + ") GROUP BY phase")
def stage_durations(spark, d):
    return metrics.phases(_stamps(spark, d), STAMPS).groupBy("phase").agg(F.count("*").alias("n"), F.min("ms").alias("least"), F.max("ms").alias("most"), F.sum("ms").alias("total"))


@query("WITH m AS (SELECT o_orderkey % 64 AS fn_id, max((epoch_us(o_orderdate) // 1000)) AS end_map FROM orders GROUP BY 1), r AS (SELECT l_suppkey % 48 AS fn_id, max((epoch_us(l_shipdate) // 1000)) AS end_reduce FROM lineitem GROUP BY 1) SELECT m.fn_id, end_map, end_reduce FROM m LEFT JOIN r ON m.fn_id = r.fn_id")
def map_reduce_stats(spark, d):
    own = table(spark, d, "orders").groupBy((F.col("o_orderkey") % 64).alias("fn_id")).agg(F.max(_ms("o_orderdate")).alias("end_map"))
    got = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 48).alias("fn_id")).agg(F.max(_ms("l_shipdate")).alias("end_reduce"))
    return metrics.joined_stages(own, got)


@query("SELECT event_id, (epoch_us(ts) // 1000) AS start, row_number() OVER (ORDER BY (epoch_us(ts) // 1000), event_id) - 1 AS y FROM events")
def timeline(spark, d):
    return metrics.timeline(table(spark, d, "events").select("event_id", _ms("ts").alias("start")), "start", "event_id")


@query("SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'click') AS communication, count(*) FILTER (event_type IS DISTINCT FROM 'click') AS compute FROM events GROUP BY 1")
def communication_compute(spark, d):
    own = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "click").alias("communication"))
    return metrics.compute_time(own)


# Tuning ---------------------------------------------------------------------------------
LINES = "l AS (SELECT doc_id, '__label__' || (quality + 1) || ' ' || text AS value FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL AND quality IS NOT NULL), x AS (SELECT doc_id, substr(value, 10, 1)::INT - 1 AS y, substr(value, 12) AS x FROM l)"


def _lines(spark, d, labels=None):
    rows = table(spark, d, "documents").join(labels or table(spark, d, "labels"), "doc_id").where("text IS NOT NULL AND quality IS NOT NULL")
    lines = rows.select("doc_id", F.concat(F.lit("__label__"), (F.col("quality") + 1).cast("string"), F.lit(" "), "text").alias("value"))
    return tuning.parse_lines(lines).select("doc_id", "y", "x")


@query(f"WITH {LINES} SELECT doc_id, y, length(x) AS n, md5(x) AS digest FROM x")
def text_label_parse(spark, d):
    return _lines(spark, d).select("doc_id", "y", F.length("x").alias("n"), F.md5(F.col("x").cast("binary")).alias("digest"))


@query(f"WITH {LINES}, c AS (SELECT doc_id, y, coalesce(sum(length(x)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM x) SELECT doc_id, y, before FROM c WHERE before <= 524288")
def text_cap(spark, d):
    return tuning.cap(_lines(spark, d), ["doc_id"], 1 << 19).select("doc_id", "y", "before")


@query(f"WITH {LINES} SELECT doc_id, y, ntile(5) OVER (PARTITION BY y ORDER BY doc_id)::INT - 1 AS fold FROM x")
def cv_folds(spark, d):
    return tuning.folds(_lines(spark, d).select("doc_id", "y"), "doc_id")


@query("SELECT norm, ngram, alpha, max_iter, penalty FROM (SELECT unnest(['l1', 'l2']) AS norm), (SELECT unnest([1, 2]) AS ngram), (SELECT unnest([0.01::DOUBLE, 0.001, 0.0001, 0.00001]) AS alpha), (SELECT unnest([10, 30, 50, 80]) AS max_iter), (SELECT unnest(['l2', 'l1', 'elasticnet']) AS penalty)")
def param_grid(spark, d):
    return tuning.grid(spark)


TERMS = "t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_][a-z0-9_]+') AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS t FROM t UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM t), h AS (SELECT doc_id, ('0x' || substr(md5(t), 1, 5))::INT % 262144 AS b, count(*) AS n FROM u GROUP BY 1, 2)"


@query(f"WITH {TERMS} SELECT doc_id, count(*) AS buckets, sum(n)::BIGINT AS terms, round(max(n) / sum(n), 9) AS l1, round(max(n) / sqrt(sum(n * n)), 9) AS l2 FROM h GROUP BY 1")
def text_hashing_tf(spark, d):
    """Terms by document, and the largest value under either norm."""
    docs = table(spark, d, "documents")
    counts = tuning.hashed_terms(docs, "doc_id", "text", ngram=2, norm=None).groupBy("id").agg(F.count("*").alias("buckets"), F.sum("value").cast("long").alias("terms"))
    for norm in ("l1", "l2"):
        own = tuning.hashed_terms(docs, "doc_id", "text", ngram=2, norm=norm).groupBy("id").agg(F.round(F.max("value"), 9).alias(norm))
        counts = counts.join(own, "id")
    return counts.withColumnRenamed("id", "doc_id")


@query()
def grid_search(spark, d):
    # Labels grow with documents: both are dealt by id, and labels are broadcast at no size.
    return tuning.search_grid(tuning.folds(_lines(spark, d, table(spark, d, "labels").hint("merge")), "doc_id"))


@query()
def grid_search_best(spark, d):
    return tuning.best_of(grid_search(spark, d))


# Rate limit -----------------------------------------------------------------------------
@query("SELECT event_id, epoch_ms(date_trunc('hour', ts)) AS window_ms, permit FROM (SELECT *, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) AS permit FROM events) WHERE permit <= 5")
def token_window(spark, d):
    return limits.admitted(table(spark, d, "events"), "1 hour", 5).select("event_id", _ms("window_start").alias("window_ms"), F.col("permit").cast("long").alias("permit"))

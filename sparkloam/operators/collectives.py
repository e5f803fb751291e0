"""Exchanges among workers as transforms of rows (worker, data)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair(workers: DataFrame, n: int) -> DataFrame:
    """Each worker of the lower half receives from its partner in the upper half."""
    half = n // 2
    lower = workers.where(F.col("worker") < half).select("worker")
    return lower.join(workers.select((F.col("worker") - half).alias("worker"), F.col("worker").alias("src"), "data"), "worker")


def broadcast(workers: DataFrame, root: int) -> DataFrame:
    data = workers.where(F.col("worker") == root).select(F.col("worker").alias("src"), "data")
    keyed = workers.select("worker", F.lit(root).cast("long").alias("src"))
    return keyed.join(F.broadcast(data), "src")  # one row


def scatter(vector: DataFrame) -> DataFrame:
    """vector: one row with an array `items`; item i goes to worker i."""
    return vector.select(F.posexplode("items").alias("worker", "data"))


def gather(workers: DataFrame) -> DataFrame:
    """All data at the root, in order of workers."""
    items = F.sort_array(F.collect_list(F.struct("worker", "data")))
    return workers.agg(F.count("*").alias("n"), F.array_join(F.transform(items, lambda x: x["data"]), "|").alias("data"))


def all_to_all(workers: DataFrame, n: int) -> DataFrame:
    """Worker i sends data:j to every j, itself too."""
    sent = workers.select(F.col("worker").alias("src"), "data", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("dst"))
    return sent.select(F.col("dst").cast("long").alias("worker"), "src", F.concat_ws(":", "data", "dst").alias("data"))


def reduce_sum(workers: DataFrame) -> DataFrame:
    """Element-wise sum of arrays `vector`."""
    return workers.select(F.posexplode("vector").alias("dim", "x")).groupBy("dim").agg(F.sum("x").alias("total"))


def group_gather(workers: DataFrame, group: int) -> DataFrame:
    """Data of each group concatenated at its first worker, in order of workers."""
    items = F.sort_array(F.collect_list(F.struct("worker", "data")))
    base = (F.floor(F.col("worker") / group) * group).alias("base")
    return workers.groupBy(base).agg(F.count("*").alias("n"), F.array_join(F.transform(items, lambda x: x["data"]), "").alias("data"))


def shuffle_repeat(workers: DataFrame, n: int, repeat: int) -> DataFrame:
    """all_to_all without oneself, repeated."""
    sent = all_to_all(workers, n).where(F.col("worker") != F.col("src"))
    return sent.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))))


def received(messages: DataFrame) -> DataFrame:
    return messages.groupBy("worker").agg(F.count("*").alias("messages"), F.sum(F.octet_length("data")).alias("bytes"))


def barrier_gather(spark, n: int) -> DataFrame:
    """n tasks started together tell each other their numbers; needs n free task slots,
    and fails where the cluster has fewer."""

    def run(_):
        from pyspark import BarrierTaskContext

        ctx = BarrierTaskContext.get()
        got = sorted(map(int, ctx.allGather(str(ctx.partitionId()))))
        yield ctx.partitionId(), len(got), sum(got)

    return spark.createDataFrame(spark.sparkContext.parallelize(range(n), n).barrier().mapPartitions(run), "worker int, n int, total int")


def fits(rows: DataFrame) -> DataFrame:
    """(worker, n, slope): each worker's least-squares slope of y over x, as one job a worker;
    rows (worker, x, y) are first summed up a part at a time, so that no worker holds its rows."""
    part = F.spark_partition_id()
    sums = [F.count("*").alias("n"), *(F.sum(e).alias(c) for c, e in (("sx", F.col("x")), ("sy", F.col("y")), ("sxx", F.col("x") * F.col("x")), ("sxy", F.col("x") * F.col("y"))))]

    def fit(pdf):
        n, sx, sy, sxx, sxy = (pdf[c].sum() for c in ("n", "sx", "sy", "sxx", "sxy"))
        low = n * sxx - sx * sx
        return pdf.head(1)[["worker"]].assign(n=int(n), slope=float((n * sxy - sx * sy) / low) if low else None)

    return rows.groupBy("worker", part.alias("part")).agg(*sums).groupBy("worker").applyInPandas(fit, "worker long, n long, slope double")


def invoked(params: DataFrame, action) -> DataFrame:
    """(worker, result): action, from a dict to a dict, on the JSON arguments of every row."""
    import json

    def run(batches):
        for pdf in batches:
            results = [json.dumps(action(json.loads(a)), separators=(",", ":")) for a in pdf["args"]]
            yield pdf[["worker"]].assign(result=results)

    return params.select(F.col("worker").cast("int").alias("worker"), "args").mapInPandas(run, "worker int, result string")

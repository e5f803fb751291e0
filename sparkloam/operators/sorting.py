"""Range-partitioned total sort: bounds from key quantiles, buckets, ranks, checks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows dealt out by ranges of the order, with the partition's number; written out, as a
    second run could draw other ranges."""
    return cut(df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in order]).withColumn("_pid", F.spark_partition_id()))


def running_sum(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of value over all rows before each in a total order, without one task
    for all: sums within range partitions, and the partitions' own sums before."""
    dealt = _ranged(df.withColumn("_v", value), order)
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    base = dealt.groupBy("_pid").agg(F.sum("_v").alias("_s")).withColumn("_base", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    own = Window.partitionBy("_pid").orderBy(*[F.col(c).asc_nulls_last() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("_own", F.coalesce(F.sum("_v").over(own), F.lit(0))).join(base, "_pid")
    return out.withColumn(name, F.col("_base") + F.col("_own")).drop("_pid", "_v", "_own", "_base")


def ranked(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Adds each row's place (from 0) in the total order."""
    return running_sum(df, order, F.lit(1).cast("long"), name)


def bounds(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """(i, bound): the keys at int(i / partitions * n) of the sorted keys, i from 1. Only the
    ranges that hold a wanted place are sorted."""
    dealt = _ranged(df.select(key).where(F.col(key).isNotNull()), [key])
    sizes = sorted((r["_pid"], r["n"]) for r in dealt.groupBy("_pid").agg(F.count("*").alias("n")).collect())  # a row a range
    places, at, n = [], 0, sum(c for _, c in sizes)
    for pid, c in sizes:
        places += [(i, pid, i * n // partitions - at) for i in range(1, partitions) if at <= i * n // partitions < at + c]
        at += c
    wanted = F.broadcast(df.sparkSession.createDataFrame(places, "i int, _pid int, _place int"))  # partitions - 1 rows
    own = dealt.join(wanted.select("_pid").distinct(), "_pid", "left_semi")
    own = own.withColumn("_place", F.row_number().over(Window.partitionBy("_pid").orderBy(key)) - 1)
    return own.join(wanted, ["_pid", "_place"]).select("i", F.col(key).alias("bound"))


def bucket(key: str, limits: list[str]) -> Column:
    """How many bounds are less than the key: a bound belongs to the bucket on its left. Every
    step-th bound is looked at first, then those between two of them: about 2 * sqrt(P)
    comparisons a key."""
    if not limits:
        return F.when(F.col(key).isNotNull(), 0)
    step = math.isqrt(len(limits) - 1) + 1
    less = lambda xs: F.size(F.filter(xs, lambda b: b < F.col(key)))
    coarse = less(F.array(*[F.lit(b) for b in limits[::step]]))
    base = F.greatest(coarse - 1, F.lit(0)) * step
    return base + less(F.slice(F.array(*[F.lit(b) for b in limits]), base + 1, F.lit(step)))


def with_buckets(df: DataFrame, key: str, partitions: int) -> DataFrame:
    limits = [r["bound"] for r in bounds(df, key, partitions).orderBy("i").collect()]  # partitions - 1 rows
    return df.where(F.col(key).isNotNull()).withColumn("bucket", bucket(key, limits))


def total_sort(df: DataFrame, key: str, partitions: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """One partition a bucket, in order of buckets, each sorted; ready for one file each."""
    dealt = with_buckets(df, key, partitions)
    return dealt.repartitionById(partitions, "bucket").sortWithinPartitions(F.col(key).asc_nulls_last(), *ties)


def unsorted_pairs(df: DataFrame, key: str, ties: tuple[str, ...]) -> DataFrame:
    """(bucket, n, unsorted): neighbours within a bucket that are out of order."""
    w = Window.partitionBy("bucket").orderBy(key, *ties)
    return df.withColumn("_before", F.lag(key).over(w)).groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(F.col("_before") > F.col(key)).alias("unsorted"))


def range_buckets(df: DataFrame, key: str, limits: DataFrame) -> DataFrame:
    """The same buckets as bucket(), by a join of keys to ranges (low, high]; limits: (i, bound)."""
    w = Window.orderBy("i")  # a row a bound
    ranges = limits.select(F.col("i").cast("int").alias("i"), F.lag("bound").over(w).alias("low"), F.col("bound").alias("high"))
    last = limits.agg(F.max("i").alias("i"), F.max("bound").alias("low")).select((F.coalesce("i", F.lit(0)) + 1).cast("int").alias("i"), "low", F.lit(None).cast("string").alias("high"))
    ranges = F.broadcast(ranges.unionByName(last))
    inside = (F.col("low").isNull() | (F.col("low") < F.col(key))) & (F.col("high").isNull() | (F.col(key) <= F.col("high")))
    return df.where(F.col(key).isNotNull()).join(ranges, inside).withColumn("bucket", F.col("i") - 1).drop("i", "low", "high")

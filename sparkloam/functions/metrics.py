"""Aggregates of run records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sorting import ranked

MIB = 1 << 20


def throughput(records: DataFrame) -> DataFrame:
    """(group_id, workers, throughput): MiB a second of each worker, added up by group.
    records: group_id, worker_id, bytes, start, end (milliseconds)."""
    own = records.groupBy("group_id", "worker_id").agg((F.sum("bytes") / MIB / ((F.max("end") - F.min("start")) / 1000.0)).alias("t"))
    return own.groupBy("group_id").agg(F.count("*").alias("workers"), F.sum("t").alias("throughput"))


def bandwidth(records: DataFrame) -> DataFrame:
    """All bytes over the time from the first start to the last end."""
    return records.groupBy("group_id").agg((F.sum("bytes") / MIB / ((F.max("end") - F.min("start")) / 1000.0)).alias("bandwidth"))


def phases(stamps: DataFrame, names: list[str], key: str = "fn_id") -> DataFrame:
    """(fn_id, phase, ms) between one stamp and the next."""
    parts = F.array(*[F.struct(F.lit(b).alias("phase"), (F.col(b) - F.col(a)).alias("ms")) for a, b in zip(names, names[1:])])
    return stamps.select(key, F.explode(parts).alias("p")).select(key, "p.phase", "p.ms")


def joined_stages(map_stats: DataFrame, reduce_stats: DataFrame) -> DataFrame:
    """Map rows with their reduce stamps where there are any."""
    return map_stats.join(reduce_stats, "fn_id", "left")


def timeline(results: DataFrame, start: str, tie: str) -> DataFrame:
    """Adds y, the row of each result in a plot ordered by start."""
    return ranked(results, [start, tie], "y")


def compute_time(times: DataFrame) -> DataFrame:
    return times.withColumn("compute", F.col("total") - F.col("communication"))

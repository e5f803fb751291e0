"""Plans as rows: splits, shares, samples, shards, groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fixed_splits(spark: SparkSession, size: int, row: int, parts: int) -> DataFrame:
    """Half-open byte ranges of whole rows; parts beyond the end are empty."""
    chunk = -(-(-(-size // parts)) // row) * row
    at = F.least(F.col("id") * chunk, F.lit(size))
    return spark.range(parts).select(F.col("id").alias("part"), at.alias("first"), F.least((F.col("id") + 1) * chunk, F.lit(size)).alias("last"))


def gather_splits(spark: SparkSession, size: int, workers: int, group: int) -> DataFrame:
    """Inclusive ranges that each group covers once, with the worker that gathers them."""
    at, each = F.col("id") % group, size // group
    first = F.when(at == 0, 0).otherwise(each * at + 1)
    last = F.when(at == group - 1, size).otherwise(each * (at + 1))
    return spark.range(workers).select(F.col("id").alias("worker"), (F.floor(F.col("id") / group) * group).alias("base"), first.cast("long").alias("first"), last.cast("long").alias("last"))


def rate_share(spark: SparkSession, rates: dict[str, int], workers: list[int]) -> DataFrame:
    """Requests a second that each of so many workers may send; at least one."""
    rows = spark.createDataFrame([(w, k, r) for w in workers for k, r in rates.items()], "workers int, kind string, rate int")
    return rows.select("workers", "kind", F.greatest(F.lit(1), F.floor(F.col("rate") / F.col("workers")) - 1).alias("share"))


def sample_fragments(spark: SparkSession, size: int, *, margin: float = 0.02, ratio: float = 0.01, most: int = 1 << 20, fragments: int = 20) -> DataFrame:
    """Distinct slots between the margins, the first by a hash of their number."""
    low, high = int(size * margin), size - int(size * margin)
    span = high - low
    each = min(int(span * ratio), most) // fragments
    slots = spark.range(span // each if each else 0).select(F.col("id").alias("slot"), F.md5(F.col("id").cast("string").cast("binary")).alias("h"))
    picked = slots.orderBy("h").limit(fragments)
    return picked.select("slot", (F.col("slot") * each + low).alias("first"), ((F.col("slot") + 1) * each + low).alias("last"))


def shards(spark: SparkSession, n: int, split: int) -> DataFrame:
    """Equal shards of n payloads."""
    if n % split:
        raise ValueError("payloads must divide into equal shards")
    return spark.range(n).select(F.col("id").alias("payload"), F.floor(F.col("id") / (n // split)).alias("shard"))


def group_ranges(spark: SparkSession, burst: int, groups: int) -> DataFrame:
    each = burst // groups
    return spark.range(groups).select(F.col("id").alias("group_id"), (F.col("id") * each).alias("first"), ((F.col("id") + 1) * each).alias("last"))


def rows_of_splits(rows: DataFrame, plan: DataFrame, at: str) -> DataFrame:
    """Rows with the split of a plan (half-open first, last) in which they start."""
    limits = F.broadcast(plan)  # a row a split
    return rows.join(limits, (F.col(at) >= F.col("first")) & (F.col(at) < F.col("last")))


def mib_share(rows: DataFrame, total: float) -> DataFrame:
    """MiB of the input for each group of `granularity` workers."""
    return rows.withColumn("mib", F.lit(total) / (F.col("workers") / F.col("granularity")))

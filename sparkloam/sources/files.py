"""Readers and writers of the supported formats, always with a given schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_delimited(spark: SparkSession, path: str, schema: str, delimiter: str = ",", strict: bool = True) -> DataFrame:
    """Headerless, unquoted lines; malformed ones fail, or are dropped if not strict."""
    return spark.read.csv(path, schema=schema, header=False, sep=delimiter, quote="", mode="FAILFAST" if strict else "DROPMALFORMED")


def write_delimited(df: DataFrame, path: str, delimiter: str = ",") -> None:
    df.write.mode("overwrite").csv(path, header=False, sep=delimiter, quote="", escape="")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, "src long, dst long", "\t")


def read_points(spark: SparkSession, path: str, dims: int, with_id: bool = False) -> DataFrame:
    """Rows of numbers as (id, v); a row with a bad cell is dropped whole. The id is the first
    cell, or else the row's place, which changes with the splits of the files."""
    names = [f"c{i}" for i in range(dims)]
    schema = ", ".join(["id long"] * with_id + [f"{c} double" for c in names])
    rows = spark.read.csv(path, schema=schema, header=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="DROPMALFORMED")
    own = F.col("id") if with_id else F.monotonically_increasing_id()
    return rows.select(own.alias("id"), F.array(*names).alias("v"))


def read_fixed(spark: SparkSession, path: str, widths: dict[str, int]) -> DataFrame:
    """Lines of columns of fixed widths."""
    rows, at, cols = spark.read.text(path), 1, []
    for name, width in widths.items():
        cols.append(F.substring("value", at, width).alias(name))
        at += width
    return rows.select(*cols)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines; compression by the file's name."""
    return spark.read.text(path)


def object_sizes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length")


def write_shards(df: DataFrame, path: str, shard: str) -> None:
    df.write.mode("overwrite").partitionBy(shard).json(path)


def append_records(df: DataFrame, path: str) -> None:
    df.write.mode("append").csv(path, header=True)


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): every object as one row, for objects that fit a task."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), "value")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def synthetic(spark: SparkSession, workers: int, size: int) -> DataFrame:
    """(worker, data): a payload of `size` bytes for every worker."""
    return spark.range(workers).select(F.col("id").alias("worker"), F.repeat(F.lit("x"), size).cast("binary").alias("data"))

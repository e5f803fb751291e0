"""Small relational operators: columns by place, lookups, rows put side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sorting import ranked


def column(df: DataFrame, place: int) -> DataFrame:
    """The column at a place, as value."""
    return df.select(df[df.columns[place]].alias("value"))


def present(df: DataFrame, key: str) -> DataFrame:
    """Rows that have a value there."""
    return df.where(F.col(key).isNotNull())


def lookup(results: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The results of the wanted keys."""
    return results.join(wanted.select(key).distinct(), key)


def zipped(left: DataFrame, by: list[str], right: DataFrame, by_right: list[str]) -> DataFrame:
    """The i-th row of one side beside the i-th of the other; what one has more is left out."""
    return ranked(left, by, "_place").join(ranked(right, by_right, "_place"), "_place").drop("_place")


def size_maps(sizes: DataFrame, row: str, key: str, size: str) -> DataFrame:
    """(row, input_partition_size, output_partition_sizes): the sizes of a row as a map."""
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, size))))
    return sizes.groupBy(row).agg(F.sum(size).alias("input_partition_size"), entries.alias("output_partition_sizes"))

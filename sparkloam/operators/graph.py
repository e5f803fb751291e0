"""Undamped PageRank by power iteration on deduplicated edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, cut_as_dealt, discard


def distinct_edges(edges: DataFrame, nodes: int) -> DataFrame:
    """Parallel edges once; then destinations modulo the number of nodes."""
    return edges.select("src", "dst").distinct().select("src", F.pmod("dst", F.lit(nodes)).alias("dst"))


def outdegree(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct().groupBy("src").agg(F.count("*").alias("outdegree"))


def node_ranges(edges: DataFrame, parts: int) -> DataFrame:
    """Half-open range of sources in each part."""
    return edges.groupBy(F.pmod("src", F.lit(parts)).alias("part")).agg(F.min("src").alias("first"), (F.max("src") + 1).alias("last"))


def weighted(edges: DataFrame, nodes: int) -> DataFrame:
    """(src, dst, outdegree), joined once and kept as dealt by source, so that no iteration
    shuffles edges: ranks move to them, and sums back."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = distinct_edges(edges, nodes).join(outdegree(edges), "src").select("src", "dst", "outdegree")
    return cut_as_dealt(cut(joined).repartition(parts, "src"))


def start(spark, nodes: int) -> DataFrame:
    return spark.range(nodes).select(F.col("id").alias("node"), F.lit(1.0 / nodes).alias("rank"))


def step(sent: DataFrame, ranks: DataFrame) -> DataFrame:
    """One iteration; a node without edges into it has rank 0."""
    got = sent.join(ranks, sent["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("rank") / F.col("outdegree")).alias("new"))
    return ranks.join(got, ranks["node"] == got["dst"], "left").select("node", F.coalesce("new", F.lit(0.0)).alias("rank"), F.col("rank").alias("old"))


def pagerank(edges: DataFrame, nodes: int, *, iterations: int | None = None, threshold: float = 5e-5, most: int = 30) -> tuple[DataFrame, list[float]]:
    """Ranks, and the L2 change of every iteration. With `iterations` so many; else until the
    change is below the threshold. Each iteration is written out, so lineage stays short."""
    spark = edges.sparkSession
    sent, ranks, errors, last = weighted(edges, nodes), start(spark, nodes), [], None
    while (len(errors) < iterations) if iterations is not None else (len(errors) < most and (not errors or errors[-1] >= threshold)):
        new = cut(step(sent, ranks))
        errors.append(new.agg(F.sqrt(F.sum(F.pow(F.col("rank") - F.col("old"), 2)))).first()[0])
        if last is not None:
            discard(last)
        last, ranks = new, new.select("node", "rank")
    return ranks, errors

"""Approximate nearest neighbours by a hierarchical small-world graph per shard.

Equal vectors are one node, which keeps the smallest ids that a search can return.
Nodes are dealt to shards of bounded size by a hash. Within a shard nodes are inserted in
that order: each links to diverse ones among its nearest predecessors, and they link
back. The index is a table of one row a shard with flat arrays. A search walks all
shards for a block of queries at a time, all queries of the block in step, and the
shards' results are merged by a window.

Defined results: vectors that are null, zero, empty or hold null, NaN or infinite
components take no part; cosine is between vectors of one dimension only; rows that
repeat an id with the same vector count once; an empty table or query set gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Nodes a shard, links a node, candidates when inserting, beam when searching, queries a block.
SHARD, LINKS, INSERT, BEAM, BLOCK = 4096, 16, 64, 64, 2048
_INDEX = "shard int, dim int, n int, vectors binary, ids binary, layers array<struct<nodes:binary,links:binary>>"


def usable(vector: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & good & F.exists(vector, lambda x: x != 0)


def vectors(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v) of the rows that take part, in double precision."""
    found = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    return found.where(F.col("id").isNotNull() & usable(F.col("v")))


def _diverse(x: np.ndarray, cand: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """For each row of candidates (nearest first, -1: none) up to `most` of them, each nearer
    to the row's node than to any taken before; places left over get the nearest of the rest."""
    n, width = cand.shape
    taken = np.full((n, most), -1, dtype=np.int32)
    size = np.zeros(n, dtype=np.int64)
    near = np.full((n, most), -np.inf)
    spare = np.zeros((n, width), dtype=bool)
    rows = np.arange(n)
    for r in range(width):
        c = cand[:, r]
        live = (c >= 0) & (size < most)
        if not live.any():
            continue
        to = np.einsum("nd,nmd->nm", x[c], x[taken])
        to[taken < 0] = -np.inf
        ok = live & (to.max(axis=1) < sims[:, r])
        spare[:, r] = live & ~ok
        taken[rows[ok], size[ok]] = c[ok]
        size[ok] += 1
    for r in range(width):
        add = spare[:, r] & (size < most)
        taken[rows[add], size[add]] = cand[add, r]
        size[add] += 1
    del near
    return taken


def build_layers(x: np.ndarray, links: int = LINKS, insert: int = INSERT) -> list[tuple[np.ndarray, np.ndarray]]:
    """x: unit vectors in insertion order. By layer from the lowest: its nodes, and for
    each the flat places (within the layer) of its links, -1 where there is none."""
    n = len(x)
    levels = np.minimum(8, (-np.log(np.random.default_rng(n).random(n)) / np.log(links)).astype(int))
    out = []
    for level in range(levels.max() + 1):
        nodes = np.flatnonzero(levels >= level).astype(np.int32)
        own, most = x[nodes], links * (2 if level == 0 else 1)
        forward = np.full((len(nodes), links), -1, dtype=np.int32)
        for a in range(0, len(nodes), 512):
            b = min(a + 512, len(nodes))
            s = own[a:b] @ own[:b].T
            s[np.arange(b)[None, :] >= np.arange(a, b)[:, None]] = -np.inf
            k = min(insert, b)
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            near = np.take_along_axis(s, top, 1)
            order = np.argsort(-near, axis=1, kind="stable")
            top, near = np.take_along_axis(top, order, 1), np.take_along_axis(near, order, 1)
            forward[a:b] = _diverse(own, np.where(np.isfinite(near), top, -1).astype(np.int32), near, links)
        src = np.repeat(np.arange(len(nodes), dtype=np.int32), links)
        dst = forward.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        ends = np.concatenate([np.stack([src, dst], 1), np.stack([dst, src], 1)])
        sim = np.einsum("nd,nd->n", own[ends[:, 0]], own[ends[:, 1]])
        ends = ends[np.lexsort((-sim, ends[:, 0]))]
        start = np.searchsorted(ends[:, 0], np.arange(len(nodes) + 1))
        wide = min(4 * most, int(np.diff(start).max(initial=0)))
        cand = np.full((len(nodes), max(1, wide)), -1, dtype=np.int32)
        for i in range(len(nodes)):
            got = ends[start[i] : start[i + 1], 1][:wide]
            cand[i, : len(got)] = got
        sims = np.full(cand.shape, -np.inf)
        graph = np.full((len(nodes), most), -1, dtype=np.int32)
        for a in range(0, len(nodes), 512):
            part = cand[a : a + 512]
            sims = np.einsum("nd,nkd->nk", own[a : a + 512], own[part])
            sims[part < 0] = -np.inf
            graph[a : a + 512] = _diverse(own, part, sims, most)
        # A node that no link leads to is put into the last place of its nearest.
        reached = np.zeros(len(nodes), dtype=bool)
        reached[graph[graph >= 0]] = True
        for i in np.flatnonzero(~reached):
            if cand[i, 0] >= 0:
                graph[cand[i, 0], -1] = i
        out.append((nodes, graph))
    return out


def search_layers(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest nodes found for each unit vector of q, and their cosines; -1 if fewer."""
    n, m = len(x), len(q)
    rows = np.arange(m)
    cur = np.zeros(m, dtype=np.int64)  # place within the layer
    for level in range(len(layers) - 1, -1, -1):
        nodes, graph = layers[level]
        if level + 1 < len(layers):
            cur = np.searchsorted(nodes, layers[level + 1][0][cur])
        if level == 0:
            break
        best = np.einsum("qd,qd->q", q, x[nodes[cur]])
        while True:
            nb = graph[cur]
            s = np.einsum("qd,qmd->qm", q, x[nodes[nb]])
            s[nb < 0] = -np.inf
            to = s.argmax(axis=1)
            better = s[rows, to] > best
            if not better.any():
                break
            cur = np.where(better, nb[rows, to], cur)
            best = np.where(better, s[rows, to], best)
    graph = layers[0][1]
    seen = np.zeros((m, n + 1), dtype=bool)
    seen[rows, cur] = True
    at = np.full((m, beam), -1, dtype=np.int64)
    sim = np.full((m, beam), -np.inf)
    done = np.ones((m, beam), dtype=bool)
    at[:, 0], sim[:, 0], done[:, 0] = cur, np.einsum("qd,qd->q", q, x[cur]), False
    while not done.all():
        live = np.flatnonzero(~done.all(axis=1))
        pick = np.where(done[live], -np.inf, sim[live]).argmax(axis=1)
        done[live, pick] = True
        nb = graph[at[live, pick]].astype(np.int64)
        nb[seen[live[:, None], nb]] = -1  # place n, which stands for none, is never seen
        s = np.einsum("qd,qmd->qm", q[live], x[nb])
        s[nb < 0] = -np.inf
        seen[live[:, None], nb] = True
        seen[:, n] = False
        alls, alla = np.concatenate([sim[live], s], 1), np.concatenate([at[live], nb], 1)
        alld = np.concatenate([done[live], nb < 0], 1)
        keep = np.argpartition(-alls, beam - 1, axis=1)[:, :beam]
        at[live], sim[live], done[live] = (np.take_along_axis(v, keep, 1) for v in (alla, alls, alld))
    order = np.argsort(-sim, axis=1, kind="stable")[:, :k]
    at, sim = np.take_along_axis(at, order, 1), np.take_along_axis(sim, order, 1)
    return np.where(np.isfinite(sim), at, -1), sim


def _unit(v: np.ndarray) -> np.ndarray:
    big = np.abs(v).max(axis=1, keepdims=True)
    v = v / big
    return v / np.sqrt(np.einsum("nd,nd->n", v, v))[:, None]


def build(rows: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 5, shard: int = SHARD) -> DataFrame:
    """The index: one row a shard and dimension. k: the most neighbours a search may ask for."""
    # The limit by rank is applied before the shuffle too, so a common vector moves few rows.
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    nodes = vectors(rows, id_column, vector_column).groupBy("v", "id").agg(F.lit(0)).select("v", "id")
    nodes = nodes.withColumn("rank", rank).where(F.col("rank") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    nodes = stored(nodes, "nodes")
    shards = max(1, -(-nodes.count() // shard))

    def index(found: pa.Table) -> pa.Table:
        dim, number = found.column("dim")[0].as_py(), found.column("shard")[0].as_py()
        v = np.array(found.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)
        ids = np.full((len(v), k + 1), -1, dtype="<i8")
        for i, own in enumerate(found.column("ids").to_pylist()):
            ids[i, : len(own)] = own
        order = np.argsort(np.array(found.column("h").to_numpy()), kind="stable")
        v, ids = v[order], ids[order]
        layers = [{"nodes": a.tobytes(), "links": g.tobytes()} for a, g in build_layers(_unit(v))]
        kinds = pa.list_(pa.struct([("nodes", pa.binary()), ("links", pa.binary())]))
        return pa.table([pa.array([number], pa.int32()), pa.array([dim], pa.int32()), pa.array([len(v)], pa.int32()), pa.array([v.astype("<f8").tobytes()], pa.binary()), pa.array([ids.tobytes()], pa.binary()), pa.array([layers], kinds)], ["shard", "dim", "n", "vectors", "ids", "layers"])

    keyed = nodes.withColumn("h", F.xxhash64("v")).withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")).withColumn("dim", F.size("v"))
    return keyed.groupBy("shard", "dim").applyInArrow(index, _INDEX)


def search(index: DataFrame, queries: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 5, beam: int = BEAM, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found, without the query's own id."""
    index = stored(index, "index")
    wanted = vectors(queries, id_column, vector_column).dropDuplicates(["id"])
    shards = index.agg(F.coalesce(F.max("shard"), F.lit(-1))).first()[0] + 1
    blocks = max(1, -(-queries.count() // block))
    # Within a block and dimension queries travel as one row, once for every shard.
    asked = wanted.withColumn("dim", F.size("v")).groupBy("dim", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
    asked = asked.agg(F.collect_list(F.struct("id", "v")).alias("q")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(max(0, shards - 1)))))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                dim = row["dim"].as_py()
                v = np.frombuffer(row["vectors"].as_py(), "<f8").reshape(-1, dim)
                ids = np.frombuffer(row["ids"].as_py(), "<i8").reshape(len(v), -1)
                layers = []
                for one in row["layers"].as_py():
                    nodes = np.frombuffer(one["nodes"], np.int32)
                    layers.append((nodes, np.frombuffer(one["links"], np.int32).reshape(len(nodes), -1)))
                q = row["q"].values
                own = q.field("id").to_numpy()
                qv = np.array(q.field("v").flatten().to_numpy(zero_copy_only=False)).reshape(len(own), dim)
                x, u = _unit(v), _unit(qv)
                at, _ = search_layers(x, layers, u, k + 1, max(beam, k + 1))
                score = np.einsum("qd,qkd->qk", u, x[at])
                cand = ids[at]
                cand[at < 0] = -1
                score = np.repeat(score, ids.shape[1], axis=1)
                cand = cand.reshape(len(own), -1)
                score[(cand < 0) | (cand == own[:, None])] = -np.inf
                order = np.lexsort((cand, -score))[:, :k]
                cand, score = np.take_along_axis(cand, order, 1), np.take_along_axis(score, order, 1)
                ok = np.isfinite(score)
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(own[:, None], ok.shape)[ok]), pa.array(cand[ok]), pa.array(score[ok])], ["query_id", "vec_id", "score"])

    # Before they are dealt to the shards the queries look small enough for a broadcast, which
    # would gather their copies for all shards in the driver.
    found = asked.hint("merge").join(index.drop("n").hint("merge"), ["shard", "dim"]).mapInArrow(walk, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_hnsw(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(build(rows), rows.where(F.col("vec_id") % 50 == 0))

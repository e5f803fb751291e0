"""Lloyd's K-means: nearest centroid, ties to the lowest number; an empty cluster's centroid is 0.

Centroids, k x d numbers, are a broadcast value, so every iteration runs the same plan. An
iteration is one job: each task assigns its points to the centroids and to those before,
and adds up sizes, sums and moves by cluster; the partial sums are then added by a shuffle.

A point whose distance to every centroid is not a number below FAR, as with NaN, belongs to
cluster 0, as in the semantics rebuilt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..session import cut

#: Fixed value: no centroid is nearest from here on.
FAR = 999_999_999_999.0
#: Numbers that a task compares at a time.
_AT_ONCE = 1 << 22


def first_points(points: DataFrame, k: int) -> list[list[float]]:
    return [list(r["v"]) for r in points.orderBy("id").limit(k).collect()]


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of and squared distances to the nearest centroids."""
    cid, dist = np.zeros(len(v), dtype=np.int32), np.empty(len(v))
    step = max(1, _AT_ONCE // max(1, centroids.size))
    for a in range(0, len(v), step):
        d = ((v[a : a + step, None, :] - centroids[None]) ** 2).sum(axis=2)
        near = np.where(d < FAR, d, np.inf).argmin(axis=1)
        cid[a : a + step] = near
        dist[a : a + step] = np.take_along_axis(d, near[:, None], 1)[:, 0]
    return cid, dist


def _matrix(column, dims: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dims)


def assign(points: DataFrame, centroids: list[list[float]]) -> DataFrame:
    """(id, v, cid, dist): the squared distance to the nearest centroid."""
    import pyarrow as pa

    known = points.sparkSession.sparkContext.broadcast(np.array(centroids, dtype=np.float64).reshape(len(centroids), -1))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cs = known.value
        for batch in batches:
            cid, dist = nearest(_matrix(batch.column("v"), cs.shape[1]), cs)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cid, pa.int32()), pa.array(dist)], ["id", "v", "cid", "dist"])

    schema = StructType([points.schema["id"], points.schema["v"], StructField("cid", IntegerType()), StructField("dist", DoubleType())])
    return points.select("id", "v").mapInArrow(local, schema)


def _sums(points: DataFrame, centroids: np.ndarray, before: np.ndarray | None) -> np.ndarray:
    """A row a cluster: its size, how many of its points moved there, and their sum."""
    import pyarrow as pa

    k, dims = centroids.shape
    known = points.sparkSession.sparkContext.broadcast((centroids, before))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cs, old = known.value
        total = np.zeros((k, 2 + dims))
        for batch in batches:
            v = _matrix(batch.column("v"), dims)
            cid, _ = nearest(v, cs)
            moved = np.ones(len(v)) if old is None else cid != nearest(v, old)[0]
            np.add.at(total, cid, np.column_stack([np.ones(len(v)), moved, v]))
        own = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(list(total[own]), pa.list_(pa.float64()))], ["cid", "t"])

    parts = points.select("v").mapInArrow(local, "cid int, t array<double>")
    got = parts.select("cid", F.posexplode("t").alias("dim", "x")).groupBy("cid", "dim").agg(F.sum("x").alias("x")).collect()
    out = np.zeros((k, 2 + dims))  # k x (2 + dims) rows, whatever the number of points
    for r in got:
        out[r["cid"], r["dim"]] = r["x"]
    return out


def lloyd(points: DataFrame, k: int, iterations: int, centroids: list[list[float]] | None = None, threshold: float | None = None) -> tuple[list[list[float]], list[tuple[int, int, float]]]:
    """Centroids, and by iteration how many points moved and their share."""
    centroids = centroids or first_points(points, k)
    if not centroids:
        return [], []
    points, now, before, moves = cut(points.select("v")), np.array(centroids, dtype=np.float64), None, []
    for i in range(iterations):
        total = _sums(points, now, before)
        n, moved = int(total[:, 0].sum()), int(total[:, 1].sum())
        moves.append((i + 1, moved, moved / n if n else 0.0))
        before, now = now, total[:, 2:] / np.maximum(total[:, :1], 1)
        if threshold is not None and moves[-1][2] <= threshold:
            break
    return now.tolist(), moves

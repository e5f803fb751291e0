"""N-gram Jaccard join by grouped prefixes.

Texts become sets of hashed shingles. A global order puts rare shingles first; with it,
two sets as similar as the threshold share a shingle among their first few, the prefix.
Sets that are equal are one node. Nodes with the same prefix and size are one group, and
only groups are posted under the shingles of their prefix. Group pairs under a shingle
that pass the size and position filters are candidates; they are expanded to members,
whose whole sets are compared.

Only connectedness is asked for, so a pair whose ends are already linked through others
needs no look. First every group meets the leader (smallest id) of each of its shingles
and every member its group's first member: as many pairs as postings at most. After
components are found, what remains are pairs under a shingle with ends in different
components; all of them are compared. Hence a group of copies costs pairs in proportion
to its size and no link is lost.

The order comes from counts in a fixed number of hash buckets; it affects speed alone.

Defined results: a null or empty text, or one of white space, has no shingles and is
linked with nothing; fewer words than n are one shingle; repeated rows are copies; a
component whose ids are all null has a null id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import groups
from .common import discard, lean, row_key, stored, table

BUCKETS, BLOCKS = 1 << 21, 256
#: Odd multipliers that mix word hashes.
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


class _Hashes(dict):
    """Hashes of words; those of short ones are kept, up to a number."""

    def __missing__(self, word: bytes) -> int:
        out = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) > 100_000:
                self.clear()
            self[word] = out
        return out


class Shingles:
    """Sorted distinct 64-bit hashes of the shingles of a text."""

    def __init__(self, n: int):
        if not 1 <= n <= len(_MIX):
            raise ValueError(f"n must be 1 to {len(_MIX)}")
        self.n, self.of = n, _Hashes()

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()
        if len(words) < self.n:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words) + 1)] if words else [], dtype=np.uint64)
        w = np.fromiter(map(self.of.__getitem__, words), dtype=np.uint64, count=len(words))
        m = len(w) - self.n + 1
        h = w[:m] * _MIX[0]
        for k in range(1, self.n):
            h ^= h >> np.uint64(29)
            h = (h + w[k : k + m]) * _MIX[k]
        h ^= h >> np.uint64(32)
        h *= _MIX[0]
        h ^= h >> np.uint64(29)
        h.sort()
        return h[np.concatenate([[True], h[1:] != h[:-1]])]


def _order(texts: DataFrame, n: int) -> np.ndarray:
    """By bucket, the logarithm of the shingles in it: BUCKETS bytes, whatever the corpus."""
    size = BUCKETS // BLOCKS

    @lean
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = Shingles(n), np.zeros(BUCKETS, dtype=np.int32)
        for batch in batches:
            for _, part in groups(batch.column("text")):
                got = np.concatenate([of(t) for t in part])
                total += np.bincount((got % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS).astype(np.int32)
        small = np.minimum(total, 65535).astype("<u2").reshape(BLOCKS, size)
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([x.tobytes() for x in small], pa.binary())], ["block", "counts"])

    @lean
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, x in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                sums[b] = sums.get(b, 0) + np.frombuffer(x, "<u2").astype(np.int64)
        out = [np.minimum(255, 4 * np.log2(x + 1)).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(out, pa.binary())], ["block", "counts"])

    parts = texts.mapInArrow(local, "block int, counts binary").repartition(BLOCKS, "block").mapInArrow(total, "block int, counts binary")
    order = np.zeros((BLOCKS, size), dtype=np.uint8)
    for r in parts.collect():  # BLOCKS rows
        order[r["block"]] = np.frombuffer(r["counts"], dtype=np.uint8)
    return order.ravel()


def _prefixes(rows: DataFrame, n: int, num: int, den: int, kind: str) -> DataFrame:
    """(doc_id, rk, n, key, same, prefix) of rows of (doc_id, rk, text). key: digest of the
    set, null if empty; same: digest of the prefix."""
    order = rows.sparkSession.sparkContext.broadcast(_order(rows.select("text"), n))  # BUCKETS bytes

    @lean
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, weight = Shingles(n), order.value
        for batch in batches:
            for at, part in groups(batch.column("text")):
                size, key, same, prefix = [], [], [], []
                for t in part:
                    h = of(t)
                    p = h
                    if len(h):
                        k = len(h) - -(-num * len(h) // den) + 1
                        p = h[np.argsort(weight[(h % np.uint64(BUCKETS)).astype(np.int64)], kind="stable")[:k]]
                    size.append(len(h))
                    key.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                    same.append(xxhash.xxh3_128_digest(p.tobytes()))
                    prefix.append(p.view(np.int64))
                flat = pa.array(np.concatenate(prefix), pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prefix])]), pa.int32()), flat)
                own = [batch.column(c).slice(at, len(part)) for c in ("doc_id", "rk")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(same, pa.binary()), lists], ["doc_id", "rk", "n", "key", "same", "prefix"])

    return rows.mapInArrow(local, f"doc_id {kind}, rk long, n long, key binary, same binary, prefix array<long>")


def _verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough, as a stored table."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(nodes.select("id", "key", "rk"), "id")

    @lean
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingles(n)
        for batch in batches:
            for at, part in groups(batch.column("text")):
                sets = [of(t).tobytes() for t in part]
                # Texts may share a row key by chance; the digest tells which one is meant.
                keys = batch.column("key").slice(at, len(part)).to_pylist()
                same = pa.array([xxhash.xxh3_128_digest(x) == k for x, k in zip(sets, keys)], pa.bool_())
                out = [batch.column("id").slice(at, len(part)), pa.array(sets, pa.binary())]
                yield pa.RecordBatch.from_arrays(out, ["id", "s"]).filter(same)

    @lean
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                p, q = (p, q) if len(p) <= len(q) else (q, p)
                both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                keep.append(den * both >= num * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = rows.join(wanted, "rk").select("id", "key", "text").mapInArrow(whole, "id long, s binary").dropDuplicates(["id"])
    sets = stored(sets, "sets")
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    both = both.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a")
    links = stored(both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "links")
    discard(sets)
    return links


def components(links: DataFrame) -> DataFrame:
    """(id, root) for the ends of links (a, b): the smallest id reachable, by alternating
    stars. Each round is written out, so that no lineage grows, and the one before deleted."""
    edges = stored(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        # Large star: of all neighbours the larger ones are hung to the smallest.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the smaller neighbours and the node itself are hung to the smallest.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = stored(small.where(F.col("u") != F.col("v")).distinct(), "edges")
        discard(edges)
        edges = new
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            out = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
            out._stored_at = edges._stored_at
            return out
        before = now


def _fits(n1: Column, p1: Column, n2: Column, p2: Column, num: int, den: int) -> Column:
    """Size filter, and position filter for the first shingle that two sets share."""
    size = den * F.least(n1, n2) >= num * F.greatest(n1, n2)
    return size & ((num + den) * (1 + F.least(n1 - p1 - 1, n2 - p2 - 1)) >= num * (n1 + n2))


def join(docs: DataFrame, *, n: int = 5, num: int = 80, den: int = 100, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, rk, n_shingles, component_id, component), one row per row. Rows are linked if
    den * intersection >= num * union of their n-word shingles. component tells components
    apart even if ids are null or repeat; it is null without shingles."""
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", row_key("doc_id", "text").alias("rk"), "text")
    own = stored(_prefixes(rows, n, num, den, kind), "prefixes")
    # A group is known by a hash of what its members share. Should two groups meet in one
    # number, more pairs are compared; none is lost.
    full = own.where(F.col("key").isNotNull()).withColumn("gid", F.xxhash64("n", "same"))
    nodes = full.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("rk").alias("rk"), F.first("n").alias("n"), F.first("gid").alias("gid"))
    nodes = stored(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    firsts = nodes.groupBy("gid").agg(F.min(F.struct("doc_id", "id")).alias("f")).select("gid", F.col("f.id").alias("first"))
    # Groups, posted under the shingles of their prefix; shingles of one group lead nowhere.
    grouped = full.groupBy("gid", "n", "same").agg(F.min("doc_id").alias("lead"), F.first("prefix").alias("prefix"))
    posts = grouped.select("gid", "lead", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = posts.groupBy("token").agg(F.count("gid").alias("many")).where(F.col("many") > 1).select("token")
    posts = stored(posts.join(shared, "token").select("token", "lead", "gid", "n", "pos"), "posts")
    # Round one: to the leader of each shingle, and to the first of each group.
    heads = posts.groupBy("token").agg(F.min(F.struct("lead", "gid", "n", "pos")).alias("head"))
    star = posts.join(heads, "token").where((F.col("gid") != F.col("head.gid")) & _fits(F.col("n"), F.col("pos"), F.col("head.n"), F.col("head.pos"), num, den))
    star = star.select(F.col("head.gid").alias("x"), F.col("gid").alias("y")).distinct()
    star = star.join(firsts.select(F.col("gid").alias("y"), F.col("first").alias("b")), "y").join(firsts.select(F.col("gid").alias("x"), F.col("first").alias("a")), "x").select("a", "b")
    inside = nodes.join(firsts, "gid").where(F.col("id") != F.col("first")).select(F.col("first").alias("a"), F.col("id").alias("b"))
    star = stored(star.unionByName(inside), "pairs")
    links = _verified(star, nodes, rows, n, num, den)
    first_roots = components(links)
    # Round two: whatever is still in different components. A group is a bucket, too, and of
    # shingles only those are spread to members whose groups differ in their components.
    rooted = stored(nodes.join(first_roots, "id", "left").select("id", "gid", "n", F.coalesce("root", "id").alias("root")), "rooted")
    ends = rooted.groupBy("gid").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    mixed = posts.join(ends, "gid").groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high")).where(F.col("low") < F.col("high")).select("token")
    kept = rooted.join(ends.where(F.col("low") < F.col("high")).select("gid"), "gid")
    spread = kept.select(F.lit(0).alias("what"), F.col("gid").alias("bucket"), "id", "n", F.lit(0).alias("pos"), "root")
    under = posts.join(mixed, "token").select("token", "gid", "pos").join(rooted, "gid")
    spread = stored(spread.unionByName(under.select(F.lit(1).alias("what"), F.col("token").alias("bucket"), "id", "n", "pos", "root")), "spread")
    discard(posts, rooted, links)
    shares = spread.groupBy("what", "bucket", "root").agg(F.count("*").alias("many"))
    main = shares.groupBy("what", "bucket").agg(F.max(F.struct("many", "root")).alias("most")).select("what", "bucket", F.col("most.root").alias("main"))
    told = stored(spread.join(main, ["what", "bucket"]), "told")
    discard(spread)
    x, y = told.where(F.col("root") != F.col("main")).alias("x"), told.alias("y")
    apart = (F.col("x.what") == F.col("y.what")) & (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.root") != F.col("y.root"))
    apart &= (F.col("y.root") == F.col("y.main")) | (F.col("x.id") < F.col("y.id"))
    rest = x.join(y, apart & _fits(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), num, den))
    rest = rest.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    rest = stored(rest.join(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "pairs")
    discard(told, star)
    more = _verified(rest, nodes, rows, n, num, den)
    # The components of both rounds' links: roots of the first stand for their components.
    roots = components(first_roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more))
    discard(rest, more, first_roots)
    at = nodes.join(roots, "id", "left").select("key", "doc_id", F.coalesce("root", "id").alias("root"))
    least = at.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = at.join(least, "root").select("key", "component_id", F.col("root").alias("component"))
    out = own.select("doc_id", "rk", F.col("n").alias("n_shingles"), "key").join(named, "key", "left")
    name = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "rk", "n_shingles", name.alias("component_id"), "component")


def op4_group_jaccard(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), n=3, num=90, den=100).drop("rk", "component")

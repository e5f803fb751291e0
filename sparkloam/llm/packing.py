"""Best-fit packing after Martello-Toth dominance reduction.

Only the lengths of pieces matter for a packing, and there are no more lengths than a
sequence has places. The driver therefore packs the histogram of lengths, whose size
does not depend on the corpus: dominating sets are fixed first, the rest is packed
best fit in decreasing order, with equal bins handled together. The plan says, for a
run of ranks within a length, which sequences and which place these pieces take. Ranks
are given in parallel: pieces of a length are dealt by a hash to as many salts as keep
each at about SALTED pieces, counted, and numbered within their salt.

Defined results: a null or empty text has one piece that holds only the end id; a
longer document gives full pieces and a last, shorter one (none if nothing remains);
repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import by_rank, forget, groups
from .common import lean, stored, table

SALTED, KEPT = 1 << 16, 100_000
#: White space other than blank and newline, or letters whose lower case or composition
#: may depend on their neighbours: such texts are encoded as they are.
_FAR = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u0130\u0250-\U0010ffff]")
#: A stop after a letter and before white space is a token of its own.
_STOP = re.compile("[.,](?<=[a-z\xdf-\xf6\xf8-\u024f][.,])(?=[ \n])")


class Words:
    """Ids of texts by a tokenizer that drops white space, as bytes of 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kept: dict[str, bytes] = {}
        self.fast = by_rank(path, "[^ ]+ ")
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _plain(self, texts: list[str]) -> list[bytes]:
        """By the tokenizer itself."""
        out = []
        for a in range(0, len(texts), 1000):
            out += [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts[a : a + 1000], add_special_tokens=False)]
        return out

    def _each(self, words: list[str]) -> dict[str, bytes]:
        """Words of letters only are one pre-token each: many are encoded as one text and
        told apart by the tokens that end a word."""
        out: dict[str, bytes] = {}
        rest = [w for w in words if not w.isalpha()]
        words = [w for w in words if w.isalpha()]
        for a in range(0, len(words), 2000):
            part = words[a : a + 2000]
            ids = self.fast.encode_to_numpy(" ".join(part) + " ")
            raw, ends = ids.astype("<u4").tobytes(), (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
            out.update(zip(part, [raw[x:y] for x, y in zip([0, *ends], ends)], strict=True))
        out.update(zip(rest, self._plain(rest), strict=True))
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        far = [t for t in texts if _FAR.search(t)]
        whole = iter(self._plain(far))
        words = [None if _FAR.search(t) else _STOP.sub(r" \g<0>", t.lower()).split() for t in texts]
        new = list(set().union(*filter(None, words)).difference(self.kept))
        self.kept.update(self._each(new))
        out = [next(whole) if w is None else b"".join(map(self.kept.__getitem__, w)) for w in words]
        forget(self.kept, new, KEPT)
        return out


@lru_cache(maxsize=1)
def words(path: str) -> Words:
    """One for all tasks of a worker; each task forgets the words it met at its end."""
    return Words(path)


def pieces(docs: DataFrame, path: str, *, size: int = 2048, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """Rows of (id, piece, start, length, ids_crc32), and the ids as binary if asked for."""
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    end = np.array([end_id], dtype="<u4").tobytes()
    fields = ["piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = words(path)
        try:
            yield from each(own, batches)
        finally:
            own.kept.clear()

    def each(own: Words, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in groups(batch.column("text")):
                of: list[int] = []
                got: dict[str, list] = {k: [] for k in fields}
                for i, ids in enumerate(own.ids(part)):
                    ids += end
                    for k, a in enumerate(range(0, len(ids), 4 * size)):
                        own_ids = ids[a : a + 4 * size]
                        of.append(at + i)
                        for name, v in zip(fields, (k, a // 4, len(own_ids) // 4, zlib.crc32(own_ids), own_ids)):
                            got[name].append(v)
                kinds = {"piece": pa.int32(), "ids": pa.binary()}
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(of, pa.int64())), *(pa.array(got[k], kinds.get(k, pa.int64())) for k in fields)], ["id", *fields])

    return rows.mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids).withColumnRenamed("id", id_column)


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, how many, first sequence, offset) for all ranks of all lengths."""
    left = {n: c for n, c in counts.items() if c > 0}
    used: dict[int, int] = defaultdict(int)
    out: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def put(length: int, many: int, first: int, offset: int) -> None:
        out.append((length, used[length], many, first, offset))
        used[length] += many
        left[length] -= many
        if not left[length]:
            del left[length]

    def fix(lengths: tuple[int, ...], many: int) -> None:
        nonlocal bins
        offset = 0
        for n in lengths:
            put(n, many, bins, offset)
            offset += n
        bins += many

    # Reduction. For the longest piece: a set that fills the sequence, or the largest
    # partner where no two others fit beside it, dominates every other set with it.
    for n in sorted(counts, reverse=True):
        while left.get(n):
            room, low = size - n, sorted(left)
            least = low[0] if low[0] != n or left[n] > 1 else (low[1] if len(low) > 1 else None)
            if least is None or least > room:
                fix((n,), left[n])
                continue
            if room in left and (room != n or left[n] > 1):
                fix((n, room), left[n] // 2 if room == n else min(left[n], left[room]))
                continue
            pair = next((m for m in reversed(low) if m <= room and (m != n or left[n] > 1)), None)
            two = _two_least(left, low, n)
            if pair is not None and (two is None or two > room):
                fix((n, pair), left[n] // 2 if pair == n else min(left[n], left[pair]))
                continue
            break
    # Best fit: open sequences by what they have room for, as runs of numbers.
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for n in sorted(left, reverse=True):
        while left.get(n):
            room = min((r for r, runs in open_.items() if r >= n and runs), default=None)
            if room is None:
                each = min(size // n, left[n])
                many = max(1, left[n] // each)
                room = size
                open_[room].append((bins, many))
                bins += many
            first, many = open_[room].pop()
            if not open_[room]:
                del open_[room]
            each = min(room // n, left[n])
            take = min(many, max(1, left[n] // each))
            if take < many:
                open_[room].append((first + take, many - take))
            for k in range(each):
                put(n, take, first, size - room + k * n)
            open_[room - each * n].append((first, take))
        open_.pop(0, None)
    return out


def _two_least(left: dict[int, int], low: list[int], n: int) -> int | None:
    """The sum of the two shortest pieces besides one of length n."""
    found: list[int] = []
    for m in low:
        found += [m] * min(2, left[m] - (m == n))
        if len(found) >= 2:
            return found[0] + found[1]
    return None


def pack(found: DataFrame, *, size: int = 2048, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds sequence_id and offset to rows that have a length of 1 to size."""
    found = stored(found, "pieces")
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    steps = sorted(plan(counts, size))
    lengths, ranks, _, first, offset = (np.array(x, dtype=np.int64) for x in (zip(*steps) if steps else [[]] * 5))
    starts = lengths * (1 << 48) + ranks

    @lean
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(starts, n * (1 << 48) + rank, side="right") - 1
            more = {"sequence_id": first[at] + rank - ranks[at], "offset": offset[at]}
            own = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *(pa.array(v, pa.int64()) for v in more.values())], [*own, *more])

    salts = [(n, -(-c // SALTED)) for n, c in counts.items()]
    salts = F.broadcast(found.sparkSession.createDataFrame(salts, "_length long, _salts long"))  # at most `size` rows
    salted = found.join(salts, F.col("length") == F.col("_length"))
    salted = salted.select(*found.columns, F.pmod(F.xxhash64(*order), "_salts").alias("salt"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = salted.withColumn("own", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order)) - 1)
    ranked = ranked.join(offsets, ["length", "salt"]).select(*found.columns, (F.col("base") + F.col("own")).alias("rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def op9_best_fit(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))

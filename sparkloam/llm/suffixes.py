"""Removal of repeated byte strings by prefix-free parsing.

The trigger of a window of `size` bytes is the least of the rolling hashes in it, so each
window has one and equal windows have equal ones. A phrase is a maximal run of windows
with one trigger; a text's phrases, which overlap by less than a window, are its parse,
and the distinct phrases under a trigger's hash are a dictionary. Equal windows are in
phrases of the same dictionary. A phrase that occurs twice in the parse has no unique
window. For the others the suffixes of the dictionary that start windows are sorted, as
far as the window reaches: neighbours with a common prefix of a window's length occur
more than once, and so do suffixes of phrases that the parse has twice.

A dictionary is small since texts are alike only by chance or copying, but a passage in
many texts can give one of any size. Beyond DICTIONARY phrases these are cut into blocks
of STEP windows, and blocks, then single windows where a block doesn't settle it, are
dealt out by their hashes and counted with a partial sum, so no task holds them all.

Defined results: null counts as empty; texts shorter than a window lose nothing;
repeated rows repeat each other, so their windows go; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from .bpe import groups
from .common import discard, lean, row_key, stored, table

DICTIONARY, GRAM, STEP, CHUNK = 512, 32, 16, 1 << 23
#: Bytes of texts that are parsed at a time; arrays of some ten times eight bytes each go with them.
AT_ONCE = 1 << 18
#: Phrases known to every task at most, and how often such a one occurs at least.
HOT, FEW = 50_000, 100
#: Odd multipliers.
_M = [
    np.uint64(x)
    for x in (
        0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0x8EBC6AF09C88C6E3,
        0xE7037ED1A0B428DB, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165,
    )
]


def bounded(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of consecutive places whose sizes add up to `most`, or of one place."""
    a, total = 0, 0
    for i, n in enumerate(sizes):
        if i > a and total + n > most:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def rolling(raw: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every `size` bytes, from those of the powers of two in it."""
    h = (raw.astype(np.uint64) + np.uint64(1)) * _M[0]
    width, k, out, done = 1, 1, None, 0
    while True:
        if size & width:
            if out is None:
                out = h
            else:
                m = len(h) - done
                out = out[: max(0, m)] * _M[8] + h[done : done + max(0, m)]
                out ^= out >> np.uint64(31)
            done += width
        if width * 2 > size:
            break
        if len(h) <= width:
            return np.empty(0, dtype=np.uint64)
        h = h[:-width] * _M[k % 8] + h[width:]
        h ^= h >> np.uint64(32)
        width, k = width * 2, k + 1
    out = out * _M[3]
    return (out ^ (out >> np.uint64(29)))[: max(0, len(raw) - size + 1)]


def phrases(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every phrase of the texts, in order: which text it is of, its first and last window
    start in it, and its trigger's hash."""
    gram, ends = min(GRAM, size), np.cumsum([len(t) for t in texts])
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    h = rolling(raw, gram)
    n, width = len(raw) - size + 1, size - gram + 1
    if n <= 0:
        return (np.empty(0, dtype=np.int64),) * 3 + (np.empty(0, dtype=np.int64),)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
    step = 1
    while step * 2 <= width:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    if step < width:
        key = np.minimum(key[:n], key[width - step : width - step + n])
    # A window that reaches into the next text is none.
    of = np.searchsorted(ends, np.arange(n), side="right")
    inside = np.arange(n) + size <= ends[of]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | ~inside[:-1]])
    first = np.flatnonzero(new & inside)
    last = np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]]))
    at = (np.uint64(0xFFFFFFFF) - (key[first] & np.uint64(0xFFFFFFFF))).astype(np.int64)
    base = np.concatenate([[0], ends])[of[first]]
    return of[first], first - base, last - base, h[at].view(np.int64)


def repeated(found: list[tuple[bytes, bool]], size: int) -> list[list[int]]:
    """For each phrase of a dictionary the starts of its windows that occur elsewhere too.
    found: phrases, and whether the parse has them more than once."""
    windows = [p[o : o + size] for p, _ in found for o in range(len(p) - size + 1)]
    of = [(k, o) for k, (p, _) in enumerate(found) for o in range(len(p) - size + 1)]
    order = sorted(range(len(windows)), key=windows.__getitem__)  # the suffix array
    out: list[list[int]] = [[] for _ in found]
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and windows[order[b]] == windows[order[a]]:
            b += 1
        if b - a > 1 or found[of[order[a]][0]][1]:
            for i in order[a:b]:
                out[of[i][0]].append(of[i][1])
        a = b
    return out


def _runs(starts: list[int], base: int, size: int) -> list[tuple[int, int]]:
    """The byte ranges that windows at these places cover."""
    out: list[tuple[int, int]] = []
    for s in sorted(starts):
        if out and s + base <= out[-1][1]:
            out[-1] = (out[-1][0], s + base + size)
        else:
            out.append((s + base, s + base + size))
    return out


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, raw, rk): the texts as bytes, with a key of the row."""
    raw = F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(id_column).alias("doc_id"), raw.alias("raw")).withColumn("rk", row_key("doc_id", "raw"))


def find(rows: DataFrame, size: int, dictionary: int = DICTIONARY) -> DataFrame:
    """(rk, d, found), stored: the byte ranges that windows which repeat cover, some of which
    overlap, of those rows that have any; d.doc_id is the id. rows: (doc_id, rk, raw)."""
    own = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, rk long"

    @lean
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in groups(batch.column("raw"), chars=1 << 20):
                raw, of, base = [], [], []
                for i, t in enumerate(part):
                    for a in range(0, max(1, len(t) - size + 1), CHUNK):  # very long texts a piece at a time
                        raw.append(t[a : a + CHUNK + size - 1])
                        of.append(at + i)
                        base.append(a)
                of, base = np.array(of), np.array(base)
                for a, b in bounded([len(t) for t in raw], AT_ONCE):
                    some = raw[a:b]
                    k, lo, hi, kh = phrases(some, size)
                    if len(k):
                        ph = [xxhash.xxh3_64_intdigest(some[i][x : y + size]) for i, x, y in zip(k.tolist(), lo.tolist(), hi.tolist())]
                        cols = [lo + base[a + k], hi + base[a + k], kh, np.array(ph, dtype=np.uint64).view(np.int64)]
                        take = pa.array(of[a + k])
                        heads = [batch.column(c).take(take) for c in ("doc_id", "rk")]
                        yield pa.RecordBatch.from_arrays([*heads, *(pa.array(x, pa.int64()) for x in cols)], ["doc_id", "rk", "lo", "hi", "kh", "ph"])

    parsed = stored(rows.where(F.octet_length("raw") >= size).mapInArrow(parse, own + ", lo long, hi long, kh long, ph long"), "parse")
    kinds = parsed.groupBy("kh", "ph").agg(F.count("*").alias("n"), F.min(F.struct("rk", "lo", "hi", "doc_id")).alias("r"))
    words = kinds.groupBy("kh").agg(F.sum("n").alias("total"), F.min("n").alias("least"), F.count("*").alias("kinds")).where(F.col("total") > 1)
    kinds = stored(kinds.join(words, "kh"), "kinds")
    # Phrases that occur again are repeated as a whole. The most frequent ones, of which there
    # are HOT at most, are known to every task and marked where they stand; the rest are joined.
    total = kinds.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = max(FEW, total // HOT)
    hot = kinds.where(F.col("n") > often).select("kh", "ph")
    found = hot.toArrow()  # at most HOT rows, as the counts add up to the total
    pairs = np.array(found.column("kh").to_numpy()), np.array(found.column("ph").to_numpy())
    at = np.lexsort(pairs[::-1])
    known = rows.sparkSession.sparkContext.broadcast(tuple(x[at] for x in pairs))

    @lean
    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The spans of frequent phrases; those that meet, in rows that stand together, as one."""
        kh, ph = known.value
        for batch in batches:
            k, p = (batch.column(c).to_numpy() for c in ("kh", "ph"))
            low, high = np.searchsorted(kh, k, "left"), np.searchsorted(kh, k, "right")
            ok = np.zeros(len(k), dtype=bool)
            for j in range(int((high - low).max(initial=0))):  # phrases under one trigger
                i = low + j
                ok |= (i < high) & (ph[np.minimum(i, len(ph) - 1)] == p)
            ok = np.flatnonzero(ok)
            if not len(ok):
                continue
            s, e, rk = batch.column("lo").to_numpy()[ok], batch.column("hi").to_numpy()[ok] + size, batch.column("rk").to_numpy()[ok]
            new = np.concatenate([[True], (rk[1:] != rk[:-1]) | (s[1:] > e[:-1]) | (s[1:] < s[:-1])])
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:], [len(ok)]]) - 1
            own_ids = [batch.column(c).take(pa.array(ok[first])) for c in ("doc_id", "rk")]
            yield pa.RecordBatch.from_arrays([*own_ids, pa.array(s[first]), pa.array(e[last])], ["doc_id", "rk", "s", "e"])

    twice = kinds.where((F.col("n") > 1) & (F.col("n") <= often)).select("kh", "ph")
    cold = parsed.join(F.broadcast(hot), ["kh", "ph"], "left_anti")  # at most HOT rows
    whole = cold.join(twice, ["kh", "ph"], "left_semi").select("doc_id", "rk", F.col("lo").alias("s"), (F.col("hi") + size).alias("e"))
    whole = whole.unionByName(parsed.mapInArrow(marked, own + ", s long, e long")) if len(found) else whole
    # Phrases that occur once but have others in their dictionary, and one of each of those.
    mixed = kinds.where((F.col("least") == 1) & (F.col("kinds") > 1))
    flags = (F.col("n") > 1).alias("twice"), (F.col("kinds") > dictionary).alias("large")
    mixed = mixed.select("r.doc_id", "r.rk", "r.lo", "r.hi", "kh", *flags)
    wanted = mixed.groupBy("rk", F.struct("doc_id").alias("d")).agg(F.collect_list(F.struct("lo", "hi", "kh", "twice", "large")).alias("p"))

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lo", "kh", "twice", "large"]
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                of, out, raw = [], {c: [] for c in names}, []
                for i, (t, ps) in enumerate(zip(part.column("raw").to_pylist(), part.column("p").to_pylist())):
                    for p in ps:
                        of.append(i)
                        raw.append(t[p["lo"] : p["hi"] + size])
                        for c in names:
                            out[c].append(p[c])
                heads = [part.column(c).take(pa.array(of, pa.int64())) for c in ("doc_id", "rk")]
                cols = [pa.array(out[c], pa.int64() if c in ("lo", "kh") else pa.bool_()) for c in names]
                yield pa.RecordBatch.from_arrays([*heads, *cols, pa.array(raw, pa.binary())], ["doc_id", "rk", *names, "raw"])

    unique_rows = rows.join(wanted, (rows["rk"] == wanted["rk"]) & rows["doc_id"].eqNullSafe(F.col("d.doc_id"))).select("doc_id", rows["rk"], "raw", "p")
    texts = stored(unique_rows.mapInArrow(cut, own + ", lo long, kh long, twice boolean, large boolean, raw binary").dropDuplicates(["rk", "lo", "kh"]), "phrases")

    @lean
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def done() -> pa.RecordBatch:
            got = repeated([(r["raw"], r["twice"]) for r in held], size)
            spans = [(r["doc_id"], r["rk"], s, e) for r, starts in zip(held, got) if not r["twice"] for s, e in _runs(starts, r["lo"], size)]
            held.clear()
            cols = [pa.array([x[k] for x in spans], pa.int64() if k else doc_type) for k in range(4)]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "rk", "s", "e"])

        doc_type = None
        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            for r in batch.to_pylist():
                if held and r["kh"] != held[0]["kh"]:
                    yield done()
                held.append(r)
        if held:
            yield done()

    small = texts.where(~F.col("large")).repartition("kh").sortWithinPartitions("kh").mapInArrow(solve, own + ", s long, e long")

    step, gram = min(STEP, max(1, size // 2)), min(GRAM, size)

    @lean
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, out = [], {c: [] for c in ("b", "s", "core", "outer", "raw")}
            for i, (lo, kh, raw) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lo", "kh", "raw")))):
                last = len(raw) - size  # of the places of windows
                p = int(np.flatnonzero(rolling(np.frombuffer(raw, np.uint8), gram).view(np.int64)[: size - gram + 1] == kh)[-1])
                for b in range((p - last) // step, p // step + 1):
                    high, low = p - step * b, p - step * b - step + 1
                    first = max(low, 0)
                    inside = low >= 0 and high <= last
                    of.append(i)
                    out["b"].append(b)
                    out["s"].append(lo + first)
                    out["core"].append(xxhash.xxh3_64_intdigest(raw[high : low + size]) >> 1)
                    out["outer"].append(xxhash.xxh3_64_intdigest(raw[low : high + size]) >> 1 if inside else None)
                    out["raw"].append(raw[first : min(high, last) + size])
            kinds = [pa.int64()] * 4 + [pa.binary()]
            heads = [batch.column(c).take(pa.array(of, pa.int64())) for c in ("doc_id", "rk", "kh", "twice")]
            cols = [pa.array(x, t) for x, t in zip(out.values(), kinds)]
            yield pa.RecordBatch.from_arrays([*heads, *cols], ["doc_id", "rk", "kh", "twice", *out])

    @lean
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [rolling(np.frombuffer(x, np.uint8), size).view(np.int64) for x in batch.column("raw").to_pylist()]
            many = [len(h) for h in hashes]
            of = pa.array(np.repeat(np.arange(len(hashes)), many))
            start = np.concatenate([np.arange(n) for n in many]) + np.repeat(batch.column("s").to_numpy(), many)
            heads = [batch.column(c).take(of) for c in ("doc_id", "rk", "kh", "twice")]
            cols = [pa.array(start, pa.int64()), pa.array(np.concatenate(hashes))]
            yield pa.RecordBatch.from_arrays([*heads, *cols], ["doc_id", "rk", "kh", "twice", "s", "wh"])

    # Blocks of windows, by their place before the trigger. What all windows of a block have
    # in common must occur twice for any of them to; if all that they cover does, all do.
    dealt = stored(texts.where("large").mapInArrow(blocks, own + ", kh long, twice boolean, b long, s long, core long, outer long, raw binary"), "blocks")
    again = (F.count("*") > 1) | F.max("twice")
    cores = dealt.groupBy("kh", "b", "core").agg(again.alias("again")).where("again").select("kh", "b", "core")
    able = stored(dealt.join(cores, ["kh", "b", "core"]), "able")
    discard(dealt)
    outers = able.where("outer IS NOT NULL").groupBy("kh", "b", "outer").agg(again.alias("again"), F.min(F.struct("rk", "s", "doc_id", "raw")).alias("r")).where("again")
    solved = able.where("NOT twice").join(outers.select("kh", "b", "outer"), ["kh", "b", "outer"]).select("doc_id", "rk", "s", (F.col("s") + F.octet_length("raw")).alias("e"))
    open_ = able.join(outers.select("kh", "b", "outer"), ["kh", "b", "outer"], "left_anti").select("doc_id", "rk", "kh", "twice", "s", "raw")
    shown = outers.select("r.doc_id", "r.rk", "kh", F.lit(True).alias("twice"), "r.s", "r.raw")
    # A common passage has its blocks in a few tasks; before they grow to windows they are dealt evenly.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    even = open_.unionByName(shown).repartition(tasks)
    single = stored(even.mapInArrow(windows, own + ", kh long, twice boolean, s long, wh long"), "windows")
    often = single.groupBy("kh", "wh").agg(again.alias("again")).where("again").select("kh", "wh")
    large = single.where(~F.col("twice")).join(often, ["kh", "wh"]).select("doc_id", "rk", "s", (F.col("s") + size).alias("e")).unionByName(solved)
    spans = whole.unionByName(small).unionByName(large)
    spans = stored(spans.groupBy("rk", F.struct("doc_id").alias("d")).agg(F.collect_set(F.struct("s", "e")).alias("found")), "spans")
    discard(parsed, kinds, texts, able, single)
    return spans


def merged(found: list[dict] | None) -> list[tuple[int, int]]:
    """Ranges in order, those that meet as one."""
    runs: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in found or []):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    return [(s, e) for s, e in runs]


def _with_spans(rows: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    same = (rows["rk"] == spans["rk"]) & rows["doc_id"].eqNullSafe(F.col("d.doc_id"))
    return rows.join(spans, same, how).select(*[rows[c] for c in rows.columns], "found")


def segments(rows: DataFrame, coarse: DataFrame, size: int) -> DataFrame:
    """(doc_id, rk, raw): the stretches of at least `size` bytes that the found ranges cover;
    doc_id holds the row's id and key and where the stretch begins."""
    kind = rows.schema["doc_id"].dataType

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                of, base, raw = [], [], []
                for i, (t, found) in enumerate(zip(part.column("raw").to_pylist(), part.column("found").to_pylist())):
                    for s, e in merged(found):
                        if e - s >= size:
                            of.append(i)
                            base.append(s)
                            raw.append(t[s:e])
                heads = [part.column(c).take(pa.array(of, pa.int64())) for c in ("doc_id", "rk")]
                yield pa.RecordBatch.from_arrays([*heads, pa.array(base, pa.int64()), pa.array(raw, pa.binary())], ["doc_id", "rk", "base", "raw"])

    out = _with_spans(rows, coarse, "inner").mapInArrow(cut, f"doc_id {kind.simpleString()}, rk long, base long, raw binary")
    return out.select(F.struct("doc_id", "rk", "base").alias("doc_id"), F.xxhash64("rk", "base").alias("rk"), "raw")


def dedup(
    docs: DataFrame,
    *,
    size: int = 400,
    coarse: int | None = None,
    dictionary: int = DICTIONARY,
    id_column: str = "doc_id",
    text_column: str = "text",
    rest: tuple[str, ...] = (),
    as_text: bool = False,
) -> DataFrame:
    """(doc_id, rk, rest, n_bytes, n_coarse, spans, kept), one row per row: a struct of the
    columns named in rest, the byte ranges that repeat, and the other bytes; as text, without
    characters of which a part is gone.

    coarse: a smaller size. Its ranges are found first, and those of `size` bytes only in
    them, as every part of a string that repeats does. n_coarse is how many bytes they cover."""
    rows = _rows(docs, id_column, text_column)
    if coarse:
        if not 0 < coarse <= size:
            raise ValueError("coarse must be 1 to size")
        first = find(rows, coarse, dictionary)
        parts = stored(segments(rows, first, size), "segments")
        at = F.col("d.doc_id.base")
        moved = F.transform("found", lambda x: F.struct((x["s"] + at).alias("s"), (x["e"] + at).alias("e")))
        fine = find(parts, size, dictionary).select(F.col("d.doc_id.rk").alias("fk"), F.struct("d.doc_id.doc_id").alias("fd"), moved.alias("part"))
        fine = fine.groupBy("fk", "fd").agg(F.flatten(F.collect_list("part")).alias("fine"))
        spans = first.join(fine, (F.col("rk") == F.col("fk")) & F.col("d").eqNullSafe(F.col("fd")), "left")
        spans = stored(spans.select("rk", "d", F.struct("fine", F.col("found").alias("wide")).alias("found")), "spans")
        discard(parts, first)
    else:
        spans = find(rows, size, dictionary)
        spans = spans.select("rk", "d", F.struct(F.col("found").alias("fine"), F.col("found").alias("wide")).alias("found"))

    @lean
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        names = ["doc_id", "rk", "rest", "n_bytes", "n_coarse", "spans", "kept"]
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                bytes_, wide, out, kept = [], [], [], []
                for raw, found in zip(part.column("raw").to_pylist(), part.column("found").to_pylist()):
                    runs = merged(found["fine"] if found else None)
                    edges = [0, *(v for r in runs for v in r), len(raw)]
                    bytes_.append(len(raw))
                    wide.append(sum(e - s for s, e in merged(found["wide"] if found else None)))
                    out.append([{"s": s, "e": e} for s, e in runs])
                    kept.append(b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2])))
                last = pa.array([x.decode(errors="ignore") for x in kept]) if as_text else pa.array(kept, pa.binary())
                heads = [part.column(c) for c in ("doc_id", "rk", "rest")]
                yield pa.RecordBatch.from_arrays([*heads, pa.array(bytes_, pa.int64()), pa.array(wide, pa.int64()), pa.array(out, pair), last], names)

    more = (F.struct(*rest) if rest else F.lit(None).cast("int")).alias("rest")
    raw = F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary")
    whole = docs.select(F.col(id_column).alias("doc_id"), raw.alias("raw"), more).withColumn("rk", row_key("doc_id", "raw"))
    span = StructType([StructField("s", LongType()), StructField("e", LongType())])
    tail = [("n_bytes", LongType()), ("n_coarse", LongType()), ("spans", ArrayType(span)), ("kept", StringType() if as_text else BinaryType())]
    heads = [whole.schema[c] for c in ("doc_id", "rk", "rest")]
    return _with_spans(whole, spans, "left").mapInArrow(keep, StructType(heads + [StructField(*x) for x in tail]))


#: Bytes of the shorter strings whose repeats are counted beside: fifty words of three letters.
PASSAGE = 200


def op5_prefix_free(spark, sf_dir: str) -> DataFrame:
    """n_passage_bytes: bytes of strings of PASSAGE bytes that start elsewhere, too, most of
    them shorter than the 400 bytes from which on they are removed."""
    out = dedup(table(spark, sf_dir, "documents"), coarse=PASSAGE)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    kept = F.sha2("kept", 256).alias("kept_sha256")
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), kept, F.col("n_coarse").alias("n_passage_bytes"))

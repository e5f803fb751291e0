"""LM scoring by prediction by partial matching over bytes.

Every training text is counted: words for the base score, and its bytes with up to ORDER
bytes of context, between begin and end marks. Counts are added up within a task before
they are shuffled. From them the driver makes a trie of bounded size: the contexts of up to
LOW bytes, whose number the alphabet bounds, and by longer order the most frequent ones,
each with its symbols; escapes are estimated by the number of different symbols (method
C), and a shorter context excludes the symbols that longer ones have. Since counts no
longer change, the code length of every symbol in every context is worked out once, and
scoring is a walk over flat arrays. Symbols whose longest context the trie lacks are
scored from the counts themselves: both are shuffled by the last LOW + 1 bytes of the
context, where all longer contexts that end in them meet.

The base score needs the count of every word. The most frequent ones, a bounded number,
are broadcast; all others are joined by a shuffle of (text, word).

Defined results: null counts as the empty text, whose only token is the end; without
training texts base and model scores are those of empty counts; repeated rows are each
learned from and scored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import groups
from .common import held_out, stored, table

#: Longest context; contexts broadcast by order, and the order up to which all are; words
#: broadcast; symbols 256 and 257 mark begin and end.
ORDER, CONTEXTS, LOW, WORDS, BEGIN, END, BITS = 4, 32_768, 2, 200_000, 256, 257, 9
#: Rows of counts and symbols that a task of `unheld` settles at a time.
ROWS = 1 << 18


def symbols(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts in a row, each after `order` begin marks and before an end mark; their starts."""
    size = np.array([len(t) for t in texts], dtype=np.int64) + order + 1
    first = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(first[-1], dtype=np.int64)
    raw = np.frombuffer((b"\0" * order).join([b"", *(t + b"\0" for t in texts)]), dtype=np.uint8)
    out[:] = raw
    for k in range(order):
        out[first[:-1] + k] = BEGIN
    out[first[1:] - 1] = END
    return out, first


def _codes(s: np.ndarray, first: np.ndarray, order: int) -> np.ndarray:
    """Each symbol with its context as one integer."""
    code = np.zeros(len(s) - order, dtype=np.int64)
    for k in range(order + 1):
        code <<= BITS
        code |= s[k : len(s) - order + k]
    keep = np.ones(len(code), dtype=bool)
    for k in range(order):
        at = first[1:-1] + k - order
        keep[at] = False
    return code[keep]


def count(train: DataFrame, order: int = ORDER) -> DataFrame:
    """(word, code, n): counts of lower-cased words, '' being the end, where code is null,
    and of symbols in context, where word is null. train: column text."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        names = ["word", "code", "n"]

        def of_words() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.nulls(len(words), pa.int64()), pa.array(list(words.values()), pa.int64())], names)
            words.clear()
            return out

        def merged() -> tuple[np.ndarray, np.ndarray]:
            code, n = (np.concatenate(x) for x in zip(*held))
            by = np.argsort(code, kind="stable")
            code, n = code[by], n[by]
            at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            return code[at], np.add.reduceat(n, at)

        for batch in batches:
            for _, part in groups(batch.column("text")):
                raw = [t.encode() for t in part]
                for t in raw:
                    words.update(t.lower().split())
                words[b""] += len(raw)
                if len(words) > 400_000:
                    yield of_words()
                held.append(np.unique(_codes(*symbols(raw, order), order), return_counts=True))
                if sum(len(c) for c, _ in held) > 3_000_000:
                    held = [merged()]
                    if len(held[0][0]) > 1_500_000:
                        yield pa.RecordBatch.from_arrays([pa.nulls(len(held[0][0]), pa.binary()), pa.array(held[0][0]), pa.array(held[0][1])], names)
                        held = []
        if words:
            yield of_words()
        if held:
            code, n = merged()
            for a in range(0, len(code), 200_000):
                part = code[a : a + 200_000]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.binary()), pa.array(part), pa.array(n[a : a + 200_000])], names)

    return train.mapInArrow(local, "word binary, code long, n long").groupBy("word", "code").agg(F.sum("n").alias("n"))


def _columns(seen: np.ndarray) -> np.ndarray:
    """Places of symbols in rows of counts; the last one is for symbols never met."""
    column = np.full(258, len(seen), dtype=np.int32)
    column[seen] = np.arange(len(seen))
    return column


def _blend(levels: Iterator[np.ndarray], shape: tuple[int, int], free: int) -> np.ndarray:
    """log10 probability by context and symbol. levels: counts of the contexts, then those of
    ever shorter ones; free: symbols never met, alike in probability."""
    p, out, rest = np.zeros(shape), np.zeros(shape, dtype=bool), np.ones(shape[0])
    for counts in levels:
        c = np.where(out, 0, counts)
        total, kinds = c.sum(axis=1), (c > 0).sum(axis=1)
        all_ = np.maximum(total + kinds, 1)
        p += rest[:, None] * c / all_[:, None]
        rest = np.where(total > 0, rest * kinds / all_, rest)
        out |= c > 0
    left = (~out[:, :-1]).sum(axis=1) + free
    each = rest / np.maximum(left, 1)
    p += np.where(out, 0, each[:, None])
    # Where nothing is left to escape to, its share goes back to the symbols met.
    p /= np.where(left > 0, 1, np.maximum(1 - rest, 1e-300))[:, None]
    return np.log10(np.maximum(p, 1e-300))


def _level(grams: list[tuple[np.ndarray, np.ndarray]], column: np.ndarray, width: int, k: int, ctx: np.ndarray) -> np.ndarray:
    """Counts of the last k symbols of each context, by symbol. Codes are sorted."""
    known, n = grams[k]
    end = ctx & ((1 << BITS * k) - 1)
    low = np.searchsorted(known, end << BITS)
    size = np.searchsorted(known, (end + 1) << BITS) - low
    at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
    m = np.zeros((len(ctx), width))
    m[np.repeat(np.arange(len(ctx)), size), column[known[at] & ((1 << BITS) - 1)]] = n[at]
    return m


def code_costs(grams: list[tuple[np.ndarray, np.ndarray]], code: np.ndarray) -> np.ndarray:
    """log10 probability of each symbol in its context. grams as for Trie, with all counts of
    the contexts and of their ends."""
    seen = np.union1d(grams[0][0], [END]).astype(np.int64)
    column, width = _columns(seen), len(seen) + 1
    contexts, of = np.unique(code >> BITS, return_inverse=True)
    by = np.argsort(of, kind="stable")
    bounds = np.searchsorted(of[by], np.arange(0, len(contexts) + 4096, 4096))
    cost = np.empty(len(code))
    for a, x, y in zip(range(0, len(contexts), 4096), bounds, bounds[1:]):
        ctx, own = contexts[a : a + 4096], by[x:y]
        levels = (_level(grams, column, width, k, ctx) for k in range(len(grams) - 1, -1, -1))
        m = _blend(levels, (len(ctx), width), 257 - len(seen))
        cost[own] = m[of[own] - a, column[code[own] & ((1 << BITS) - 1)]]
    return cost


class Trie:
    """Contexts by order as flat arrays. child[k][c, s]: the context of order k + 1 that is
    context c of order k and then symbol s, or -1. cost: log10 probability by context and
    symbol, all orders one after another from base[k] on."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]], whole: bool = True):
        """grams[k]: codes of k bytes of context and a symbol, and their counts. whole: they
        have every context, so one that is not there was never met."""
        self.whole, self.low = whole, grams[: LOW + 1]
        seen = np.union1d(grams[0][0], [END]).astype(np.int64)
        width = len(seen) + 1  # the last column is for symbols never met
        self.column = _columns(seen)
        self.context = self.column.copy()
        self.context[BEGIN] = width
        kept = [np.zeros(1, dtype=np.int64)]  # sorted contexts by order
        self.child = []
        for k in range(1, len(grams)):
            found = np.unique(grams[k][0] >> BITS)
            low, up = found & ((1 << BITS * (k - 1)) - 1), found >> BITS
            inside = lambda a, of: of[np.minimum(np.searchsorted(of, a), len(of) - 1)] == a
            found = found[inside(low, kept[-1]) & inside(up, kept[-1])] if len(found) else found
            child = np.full((len(kept[-1]), width + 1), -1, dtype=np.int32)
            child[np.searchsorted(kept[-1], found >> BITS), self.context[found & ((1 << BITS) - 1)]] = np.arange(len(found))
            child[:, width - 1] = -1
            self.child.append(child)
            kept.append(found)
        self.base = np.cumsum([0, *(len(x) for x in kept)])
        self.cost = np.empty((self.base[-1], width), dtype=np.float32)
        free = 257 - len(seen)  # symbols never met, alike in probability
        for k, found in enumerate(kept):
            for a in range(0, len(found), 4096):
                ctx = found[a : a + 4096]
                levels = (_level(grams, self.column, width, j, ctx) for j in range(k, -1, -1))
                self.cost[self.base[k] + a : self.base[k] + a + len(ctx)] = _blend(levels, (len(ctx), width), free)

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The scores of the texts, without those symbols whose longest context may have counts
        that are not here; the codes of these, text after text, and how many each text has."""
        order = len(self.child)
        s, first = symbols(texts, order)
        col, con = self.column[s], self.context[s]
        state = np.zeros(len(s), dtype=np.int32)
        here = np.zeros(len(s), dtype=np.int32)
        for k, child in enumerate(self.child):
            nxt = np.full(len(s), -1, dtype=np.int32)
            if len(child):
                before = here[:-1]
                nxt[1:] = np.where(before >= 0, child[np.maximum(before, 0), con[:-1]], -1)
            here = nxt
            np.copyto(state, here + np.int32(self.base[k + 1]), where=here >= 0)
        cost = self.cost[state, col].astype(np.float64)
        for k in range(order):
            cost[first[:-1] + k] = 0
        rest = (here < 0) & (not self.whole)
        for k in range(order):
            rest[first[:-1] + k] = False
        at = np.flatnonzero(rest)
        cost[at] = 0
        code = np.zeros(len(at), dtype=np.int64)
        for k in range(order + 1):
            code = code << BITS | s[at - order + k]
        return np.add.reduceat(cost, first[:-1]), code, np.diff(np.searchsorted(at, first))


def _numpy(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = df.toArrow()
    code, n = (got.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("code", "n"))
    by = np.argsort(code)
    return code[by], n[by]


def frequent(rows: DataFrame, count: str, most: int) -> tuple[Column, bool]:
    """A condition that keeps the rows with the largest counts, `most` at most, by a bound on
    the count, and whether it keeps all. Counts of one level, which are equal or, above 1,024,
    alike within 3 %, stay or go together. So no task sorts or gathers the rows."""
    n = F.col(count)
    level = F.when(n < 1024, n).otherwise(1024 + F.floor(32 * F.log2(n / 1024))).cast("long")
    sizes = sorted(((r["level"], r["rows"]) for r in rows.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).collect()), reverse=True)
    kept, least = 0, 1 << 62
    for own, many in sizes:  # some 3,000 levels at most
        if kept + many > most:
            return level >= least, False
        kept, least = kept + many, own
    return level >= F.lit(0), True


def fit(counts: DataFrame, order: int = ORDER, contexts: int = CONTEXTS) -> Trie:
    """counts as count() gives them. What comes to the driver is bounded by the contexts of up
    to LOW bytes and `contexts` ones of each longer order, with 257 symbols at most each."""
    grams, whole = [], True
    code = counts.where(F.col("code").isNotNull()).select("code", "n")
    for k in range(order, -1, -1):
        if k < order:
            code = code.groupBy((F.col("code") % (1 << BITS * (k + 1))).alias("code")).agg(F.sum("n").alias("n"))
        if k <= LOW:
            grams.append(_numpy(code))  # as many as the alphabet allows
            continue
        shift = F.shiftright(F.col("code"), BITS)
        sums = code.groupBy(shift.alias("c")).agg(F.sum("n").alias("m"))
        often, all_ = frequent(sums, "m", contexts)
        top = sums.where(often).select("c")
        grams.append(_numpy(code.join(F.broadcast(top), shift == F.col("c"), "left_semi")))  # at most `contexts` contexts
        whole &= all_
    return Trie(grams[::-1], whole)


def unheld(parts: DataFrame, counts: DataFrame, trie: Trie) -> DataFrame:
    """(row, score): what the symbols that the trie does not score add to each row, from all
    counts. parts: row and codes."""
    low = parts.sparkSession.sparkContext.broadcast(trie.low)
    order, mask = len(trie.child), (1 << BITS * (LOW + 1)) - 1
    names, most = ["row", "score"], ROWS

    def settled(row: np.ndarray, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        """All rows of some keys."""
        asked = n == 0
        keys, key = np.unique(code[asked] >> BITS & mask), code >> BITS & mask
        known = ~asked & np.isin(key, keys)
        grams = list(low.value)
        for k in range(LOW + 1, order + 1):
            own, of = np.unique(code[known] & ((1 << BITS * (k + 1)) - 1), return_inverse=True)
            total = np.zeros(len(own), dtype=np.int64)
            np.add.at(total, of, n[known])
            grams.append((own, total))
        rows, of = np.unique(row[asked], return_inverse=True)
        score = np.bincount(of, code_costs(grams, code[asked]), len(rows))
        return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(score)], names)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, limit = [], 0, most
        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "code", "n")))
            size += batch.num_rows
            if size >= limit:
                row, code, n = (np.concatenate(x) for x in zip(*held))
                key = code >> BITS & mask
                cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
                if cut:
                    yield settled(row[:cut], code[:cut], n[:cut])
                held, size = [(row[cut:], code[cut:], n[cut:])], len(row) - cut
                limit = max(most, 2 * size)
        if size:
            yield settled(*(np.concatenate(x) for x in zip(*held)))

    asked = parts.select("row", F.explode("codes").alias("code"), F.lit(0).cast("long").alias("n"))
    learned = counts.where(F.col("code").isNotNull()).select(F.lit(-1).cast("long").alias("row"), "code", "n")
    key = F.shiftright("code", BITS).bitwiseAND(F.lit(mask))
    both = asked.unionByName(learned).withColumn("key", key).repartition("key").sortWithinPartitions("key")
    return both.drop("key").mapInArrow(local, "row long, score double")


def score(docs: DataFrame, counts: DataFrame, trie: Trie, *, keep: list[str], words: int = WORDS) -> DataFrame:
    """The columns to keep, n_tokens, n_known, train_tokens, base_score and score.
    docs: the columns to keep and text, without nulls."""
    spark = docs.sparkSession
    of_words = counts.where(F.col("code").isNull()).select("word", "n")
    total, distinct = of_words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    often, all_words = frequent(of_words, "n", words)
    top = of_words.where(often)
    got = top.toArrow()
    common = spark.sparkContext.broadcast((dict(zip(got.column("word").to_pylist(), got.column("n").to_pylist())), trie))
    rare = of_words.join(F.broadcast(top.select("word")), "word", "left_anti") if not all_words else of_words.where("false")  # top: at most `words` rows
    names = ["row", "word", "tf", "n_tokens", "n_known", "part", "score", "codes"]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = common.value
        logs = {w: math.log10(n + 1) for w, n in known.items()}
        for batch in batches:
            rows = batch.column("row").to_pylist()
            for at, part in groups(batch.column("text")):
                raw = [t.encode() for t in part]
                out: dict[str, list] = {c: [] for c in names[:-1]}
                of: list[int | None] = []
                size: list[int] = [0]
                own_score, codes, n_codes = model.score(raw)
                for i, (row, t, s, m) in enumerate(zip(rows[at : at + len(part)], raw, own_score.tolist(), n_codes.tolist())):
                    tf = Counter(t.lower().split())
                    tf[b""] = 1
                    met = [(logs[w], n) for w, n in tf.items() if w in logs]
                    rest = [(w, n) for w, n in tf.items() if w not in logs] if len(met) < len(tf) else []
                    # The text's own row has a key that no word equals; the others are joined to counts.
                    of += [at + i] + [None] * len(rest)
                    size += [m] + [0] * len(rest)
                    out["row"] += [row] * (1 + len(rest))
                    out["word"] += [b" %d" % row, *(w for w, _ in rest)]
                    out["tf"] += [0, *(n for _, n in rest)]
                    for c, v, empty in (("n_tokens", sum(tf.values()), 0), ("n_known", sum(n for _, n in met), 0), ("part", sum(x * n for x, n in met), 0.0), ("score", s, 0.0)):
                        out[c] += [v] + [empty] * len(rest)
                kinds = [pa.int64(), pa.binary(), *[pa.int64()] * 3, pa.float64(), pa.float64()]
                own = [batch.column(c).take(pa.array(of, pa.int64())) for c in keep]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(size), pa.int32()), pa.array(codes, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(pa.array(out[c], t) for c, t in zip(names, kinds)), lists, *own], [*names, *keep])

    rows = docs.withColumn("row", F.monotonically_increasing_id())
    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    parts = rows.mapInArrow(local, "row long, word binary, tf long, n_tokens long, n_known long, part double, score double, codes array<long>" + more)
    if not trie.whole:
        parts = stored(parts, "parts")  # read twice
    joined = parts.join(rare, "word", "left") if not all_words else parts.withColumn("n", F.lit(None).cast("long"))
    if not trie.whole:
        joined = joined.drop("codes").unionByName(unheld(parts, counts, trie), allowMissingColumns=True)
    sums = joined.groupBy("row").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("n_known"),
        F.sum(F.col("part") + F.coalesce(F.col("tf") * F.log10(F.col("n") + 1.0), F.lit(0.0))).alias("part"),
        F.sum("score").alias("score"),
        *(F.first(c, ignorenulls=True).alias(c) for c in keep),
    )
    base = F.col("part") - F.col("n_tokens") * math.log10(total + distinct + 1)
    return sums.select(*keep, "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op10_ppm(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    counts = stored(count(docs.where(~F.col("held_out"))), "counts")
    return score(docs, counts, fit(counts), keep=["doc_id", "held_out"])

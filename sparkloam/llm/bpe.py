"""Byte-level BPE by tree concatenation.

A text longer than `leaf` characters is halved until its parts fit. The leaves are
encoded, neighbours by the same call; texts beyond `spread` characters have their
leaves dealt out to all executors first. Two encoded halves are joined by encoding
again a window of whole tokens around the cut, doubled until its first and last
tokens equal those that both halves have there. Between equal neighbours in BPE every
adjacent pair is one that the encoder itself makes, so the joined ids are those of
the whole text.

Leaves are encoded by runs of white space and the word after them. No rule of the
pre-tokenizer reaches across such a boundary, so equal runs have equal ids, and a
worker keeps those that it met.

Defined results: a null text counts as empty; an empty text has no ids and decodes to
the empty text; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF, SPREAD, GUARD, WINDOW, KEPT = 4096, 1 << 16, 2, 48, 300_000
#: A run of white space and a word, cut before a stop that follows a letter or number.
_RUNS = re.compile(r"[ \n]*+[^ \n.,]++(?<=[^\W_])(?=[.,])|[ \n]*+[^ \n]+|[ \n]+")
#: All that counts as white space in Python or Unicode, besides blank and newline.
_ODD = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0  -     　]")


def _vocabulary(path: str) -> tuple[dict[str, int], dict[str, bytes], dict[int, bytes]]:
    """Plain tokens with their ids and bytes, and the bytes of added tokens by id.
    Byte-level vocabularies write a printable byte as itself and the others, in order, as
    the characters from 256 on."""
    spec = json.load(open(path, encoding="utf-8"))
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    added = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    ids = {t: i for t, i in spec["model"]["vocab"].items() if i not in added}
    end = spec["model"].get("end_of_word_suffix") or "\0"
    raw = {t: bytes(of[c] for c in t.removesuffix(end)) + b" " * t.endswith(end) if t != end else t.encode() for t in ids}
    return ids, raw, added


def byte_table(path: str) -> list[bytes]:
    """The bytes of each id."""
    ids, raw, added = _vocabulary(path)
    table = {i: raw[t] for t, i in ids.items()} | added
    return [table.get(i, b"") for i in range(max(table) + 1)]


def by_rank(path: str, pattern: str):
    """The same merges for texts of which every match of pattern is one pre-token, much
    faster. A token that ends a word ends in a blank here. Ids must be in the order of the
    merges; and as every token is what its own bytes are encoded as, merging by the rank of
    the result is merging by rules."""
    import tiktoken

    ids, raw, _ = _vocabulary(path)
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks={raw[t]: i for t, i in ids.items()}, special_tokens={})


class Encoder:
    """Encodes texts as the tokenizer file at path does, without special tokens added."""

    def __init__(self, path: str, leaf: int = LEAF):
        from tokenizers import Tokenizer

        self.leaf = max(2, leaf)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bytes = byte_table(path)
        self.sizes = np.array([len(b) for b in self.bytes])
        self.fast = by_rank(path, " [^ ]+")
        self.kept: dict[str, bytes] = {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, runs: list[str]) -> dict[str, bytes]:
        """Runs of blanks and letters stay apart when they stand one after another: many are
        encoded as one text and told apart by the bytes of their tokens."""
        out: dict[str, bytes] = {}
        rest = [r for r in runs if not (r[0] == " " and r[1:].isalpha())]
        runs = [r for r in runs if r[0] == " " and r[1:].isalpha()]
        for a in range(0, len(runs), 2000):
            part = runs[a : a + 2000]
            ids = self.fast.encode_to_numpy("".join(part))
            raw = ids.astype("<u4").tobytes()
            ends = (4 * np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(r.encode()) for r in part])) + 4).tolist()
            out.update(zip(part, [raw[x:y] for x, y in zip([0, *ends], ends)]))
        for a in range(0, len(rest), 1000):
            out.update(zip(rest[a : a + 1000], self._plain(rest[a : a + 1000])))
        return out

    def leaves(self, texts: list[str]) -> list[np.ndarray]:
        odd = [t for t in texts if _ODD.search(t)]
        whole = (x for a in range(0, len(odd), 1000) for x in self._plain(odd[a : a + 1000]))
        runs = [None if _ODD.search(t) else _RUNS.findall(t) for t in texts]
        new = list(set().union(*filter(None, runs)).difference(self.kept))
        self.kept.update(self._each(new))
        out = [np.frombuffer(next(whole) if r is None else b"".join(map(self.kept.__getitem__, r)), dtype="<u4") for r in runs]
        forget(self.kept, new, KEPT)
        return out

    def spans(self, n: int) -> list[tuple[int, int]]:
        """The leaves of a text of n characters, in order."""
        todo, out = [(0, n)], []
        while todo:
            a, b = todo.pop()
            if b - a <= self.leaf:
                out.append((a, b))
            else:
                todo += [((a + b) // 2, b), (a, (a + b) // 2)]
        return out

    def fold(self, parts: list[np.ndarray], n: int) -> np.ndarray:
        """Joins the leaves of a text of n characters up the tree."""
        at = iter(parts)

        def up(a: int, b: int) -> np.ndarray:
            if b - a <= self.leaf:
                return next(at)
            left = up(a, (a + b) // 2)
            return self.join(left, up((a + b) // 2, b))

        return up(0, n)

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(left) or not len(right):
            return left if len(left) else right
        table, size = self.bytes, WINDOW
        while True:
            i, got = len(left), 0
            while i and (got < size or table[left[i]][0] & 0xC0 == 0x80):
                i -= 1
                got += len(table[left[i]])
            j, got = 0, 0
            while j < len(right) and (got < size or table[right[j]][0] & 0xC0 == 0x80):
                got += len(table[right[j]])
                j += 1
            text = b"".join(table[t] for t in (*left[i:].tolist(), *right[:j].tolist())).decode()
            mid = np.frombuffer(self._plain([text])[0], dtype="<u4")
            if (i == 0 or np.array_equal(mid[:GUARD], left[i : i + GUARD])) and (j == len(right) or np.array_equal(mid[-GUARD:], right[j - GUARD : j])):
                return np.concatenate([left[:i], mid, right[j:]])
            size *= 2

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.spans(len(t)) for t in texts]
        done = iter(self.leaves([t[a:b] for t, spans in zip(texts, cut) for a, b in spans]))
        return [self.fold([next(done) for _ in spans], len(t)) for t, spans in zip(texts, cut)]


@lru_cache(maxsize=2)
def encoder(path: str, leaf: int) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path, leaf)


def forget(kept: dict, new: list, most: int) -> None:
    """Takes the last of the new keys out again, down to so many in all, and long ones."""
    first = max(0, len(new) - max(0, len(kept) - most))
    for i, key in enumerate(new):
        if i >= first or len(key) > 64:
            del kept[key]


def groups(values: pa.Array | list[str], chars: int = 1 << 21, rows: int = 1024) -> Iterator[tuple[int, list[str]]]:
    """Consecutive values by bounded size, with the place of the first. Of an Arrow array only
    so many are Python objects at a time."""
    for base in range(0, len(values), rows):
        part = values[base : base + rows] if isinstance(values, list) else values.slice(base, rows).to_pylist()
        at, size = 0, 0
        for i, v in enumerate(part):
            size += len(v)
            if size >= chars:
                yield base + at, part[at : i + 1]
                at, size = i + 1, 0
        if at < len(part):
            yield base + at, part[at:]


def encode(docs: DataFrame, path: str, *, id_column: str = "doc_id", text_column: str = "text", leaf: int = LEAF, spread: int = SPREAD) -> DataFrame:
    """Rows of (id, ids): the ids as little-endian unsigned 32-bit integers in a binary."""
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, leaf)
        for batch in batches:
            ids = batch.column("id")
            for at, part in groups(batch.column("text")):
                out = [x.tobytes() for x in own.encode(part)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), pa.array(out, pa.binary())], ["id", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder.__new__(Encoder)
        own.leaf = max(2, leaf)
        for batch in batches:
            for k, t in enumerate(batch.column("text").to_pylist()):
                spans = own.spans(len(t))
                for at in range(0, len(spans), 256):
                    part = spans[at : at + 256]
                    same = pa.array([k] * len(part))
                    more = [pa.array([len(t)] * len(part), pa.int32()), pa.array([a for a, _ in part], pa.int32()), pa.array([t[a:b] for a, b in part], pa.string())]
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(same), batch.column("row").take(same), *more], ["id", "row", "n", "at", "text"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, leaf)
        for batch in batches:
            for at, part in groups(batch.column("text")):
                rest = [batch.column(c).slice(at, len(part)) for c in ("id", "row", "n", "at")]
                yield pa.RecordBatch.from_arrays([*rest, pa.array([x.tobytes() for x in own.leaves(part)], pa.binary())], ["id", "row", "n", "at", "ids"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, leaf)
        for batch in batches:
            out = [own.fold([np.frombuffer(p["ids"], dtype="<u4") for p in parts], n).tobytes() for parts, n in zip(batch.column("parts").to_pylist(), batch.column("n").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "ids"])

    short = rows.where(F.length("text") <= spread).mapInArrow(whole, f"id {kind}, ids binary")
    long = (
        rows.where(F.length("text") > spread)
        .withColumn("row", F.monotonically_increasing_id())
        .mapInArrow(cut, f"id {kind}, row long, n int, at int, text string")
        .repartition(F.col("row"), F.col("at"))
        .mapInArrow(leaves, f"id {kind}, row long, n int, at int, ids binary")
        .groupBy("row", "id", "n")
        .agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("parts"))
        .select("id", "n", "parts")
        .mapInArrow(joined, f"id {kind}, ids binary")
    )
    return short.unionByName(long).withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, path: str, *, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """Rows of (id, ids, text): each id's bytes in turn, read as UTF-8."""
    kind = encoded.schema[id_column].dataType.simpleString()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = byte_table(path).__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [b"".join(map(of, np.frombuffer(x or b"", dtype="<u4").tolist())).decode("utf-8", "replace") for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("ids"), pa.array(out, pa.string())], ["id", "ids", "text"])

    rows = encoded.select(F.col(id_column).alias("id"), F.col(ids_column).alias("ids"))
    return rows.mapInArrow(texts, f"id {kind}, ids binary, text string").withColumnRenamed("id", id_column)


def op2_bpe_tree(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = encode(table(spark, sf_dir, "documents"), path)
    return decode(coded, path).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))

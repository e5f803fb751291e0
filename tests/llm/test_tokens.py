import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloam.llm import bpe, packing

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
HARD = [
    None, "", " ", "\n\n  \n", "a" * 9000, "don't we'll 'sabc ''ll !'re" * 300, "x<|endoftext|>y" * 400, "é日本語 ñ" * 900, " a　 b\x1c c\t\td " * 500,
    "ПРИВЕТ", "ΑΒΓ", "Ａ", "ẞ", "Ωmega", "Å", "İ", "ΟΔΟΣ", "ǅ", "ŉ", "ﬁ", "가각", "e\u0301", "A\u030a", "ÀÉÎÕÜ", "Ǆ", "K", "\u2126", "ａｂＣ", "x" * 500,
    "1234567890" * 1200, "#'s!!'ll" * 900, " " * 7000 + "end", "\n" * 5000, "word " * 4000, "🎉👨‍👩‍👧" * 700, "<|startoftext|>Hi<|endoftext|> İstanbul ǅ" * 200,
]


def _mixed(seed: int) -> str:
    r = random.Random(seed)
    parts = ["the", " ", "  ", "\n", "'", "ll", "s", "<|endoftext|>", "é", "日", "12", "!!", "\t", "Zeit", " ", "é", "\r\n", "ion"]
    return "".join(r.choice(parts) for _ in range(r.randrange(400)))


@pytest.mark.parametrize("leaf", [2, 7, 64, 4096])
def test_tree_gives_the_ids_of_the_whole_text(leaf):
    tok, own = Tokenizer.from_file(BYTE), bpe.Encoder(BYTE, leaf)
    texts = [t[: 60 * leaf] for t in HARD if t] + [_mixed(i) for i in range(150)]
    for t, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids, t[:80]


def test_encode_and_decode(spark):
    rows = [(i, t, 7) for i, t in enumerate(HARD)] + [(3, HARD[3], 7), (None, "no id", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    tok = Tokenizer.from_file(BYTE)
    for spread in (1 << 20, 3000):
        out = bpe.decode(bpe.encode(docs, BYTE, leaf=512, spread=spread), BYTE).collect()
        assert len(out) == len(rows)
        for r in out:
            t = "no id" if r.doc_id is None else HARD[r.doc_id] or ""
            ids = tok.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(r.ids, "<u4").tolist() == ids
            assert r.text == tok.decode(ids, skip_special_tokens=False) == t
    assert bpe.decode(bpe.encode(docs.where("false"), BYTE), BYTE).count() == 0


def test_words_as_the_library(spark):
    tok, own = Tokenizer.from_file(WORD), packing.Words(WORD)
    texts = [t or "" for t in HARD] + [_mixed(i) for i in range(200)]
    for t, ids in zip(texts, own.ids(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t[:80]


def test_short_texts_of_any_script():
    """One word, or a few, from all of the lower planes: what normalising changes is encoded as the library does."""
    r = random.Random(3)
    letters = [chr(c) for c in [*range(33, 0x600), *range(0x1E00, 0x2200), *range(0x3040, 0x3100), *range(0xAC00, 0xAC80), *range(0xFB00, 0xFB10), *range(0xFF10, 0xFF60)]]
    one = [c * k for c in letters for k in (1, 2)]
    texts = one + ["".join(r.choice(letters[: r.choice([200, len(letters)])]) for _ in range(r.randrange(1, 9))) for _ in range(6000)]
    texts += [" ".join(r.sample(texts, 3)) for _ in range(1500)]
    for path, encode in ((WORD, lambda x: packing.Words(WORD).ids(x)), (BYTE, lambda x: [i.tobytes() for i in bpe.Encoder(BYTE, 4).encode(x)])):
        want = Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)
        wrong = [t for t, ids, e in zip(texts, encode(texts), want) if np.frombuffer(ids, "<u4").tolist() != e.ids]
        assert not wrong, wrong[:5]


@pytest.mark.parametrize("path,pattern,end", [(BYTE, " [^ ]+", ""), (WORD, "[^ ]+ ", "</w>")])
def test_merging_by_rank_is_merging_by_rules(path, pattern, end):
    """Ids follow the merges, and every token is what its own bytes are encoded as."""
    import json

    spec = json.load(open(path))
    vocab = spec["model"]["vocab"]
    at = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    assert at == sorted(at) and min(at) >= 256
    parts, rank = dict(zip(at, spec["model"]["merges"])), {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(spec["model"]["merges"])}
    for t, i in vocab.items():
        if i not in parts:
            continue
        s = [*t.removesuffix(end), end] if end and t.endswith(end) else [*t]
        s = [*s[:-2], s[-2] + end] if end and t.endswith(end) else s
        while len(s) > 1:
            k = min(range(len(s) - 1), key=lambda k: rank.get((s[k], s[k + 1]), 1 << 30))
            assert (s[k], s[k + 1]) in rank, t
            s[k : k + 2] = [s[k] + s[k + 1]]
        assert s == [t]


def _least(lengths, size):
    """Exact number of bins by trying all."""
    best = [len(lengths)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for b in {*bins}:
            if b >= lengths[k]:
                at = bins.index(b)
                go(k + 1, [*bins[:at], b - lengths[k], *bins[at + 1 :]])
        go(k + 1, [*bins, size - lengths[k]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(25))
def test_plan_is_valid_and_near_the_least(seed):
    r = random.Random(seed)
    size = r.choice([8, 10, 20, 30])
    lengths = sorted((r.randint(1, size) for _ in range(r.randint(0, 9))), reverse=True)
    steps = packing.plan({n: lengths.count(n) for n in lengths}, size)
    bins, ranks = defaultdict(list), defaultdict(list)
    for n, rank, many, first, offset in steps:
        for k in range(many):
            bins[first + k].append((offset, n))
            ranks[n].append(rank + k)
    assert {n: sorted(x) for n, x in ranks.items()} == {n: list(range(lengths.count(n))) for n in lengths}
    for own in bins.values():
        end = 0
        for offset, n in sorted(own):
            assert offset == end
            end += n
        assert end <= size
    assert len(bins) <= _least(lengths, size) + 1


def test_reduction_fixes_dominating_sets():
    """What the reduction alone packs: full pairs, large pieces alone, and the largest partner."""
    steps = packing.plan({9: 1, 6: 2, 4: 3, 1: 1}, 10)
    bins = defaultdict(list)
    for n, _, many, first, _ in steps:
        for k in range(many):
            bins[first + k].append(n)
    assert sorted(map(sorted, bins.values())) == [[1, 9], [4], [4, 6], [4, 6]]
    # The pair that fills a sequence is fixed, the rest stands alone.
    assert 1 + max(first + many - 1 for _, _, many, first, _ in packing.plan({7: 1, 3: 1, 8: 1}, 10)) == 2
    # Only one piece fits beside 6, and no two do: the largest partner is fixed.
    bins = defaultdict(list)
    for n, _, many, first, _ in packing.plan({6: 1, 3: 1, 2: 1, 5: 1}, 10):
        for k in range(many):
            bins[first + k].append(n)
    assert [3, 6] in [sorted(b) for b in bins.values()]


def test_many_pieces_of_one_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "SALTED", 7)
    docs = spark.createDataFrame([(i % 50, "one two three") for i in range(300)], "doc_id long, text string")
    out = packing.pack(packing.pieces(docs, WORD)).collect()
    assert len({(r.sequence_id, r.offset) for r in out}) == 300 and len({r.sequence_id for r in out}) == -(-sum(r.length for r in out) // 2048)


def test_pack(spark):
    rows = [(i, t, "x") for i, t in enumerate(HARD)] + [(i % 5, "copy of it", "x") for i in range(40)] + [(None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    tok = Tokenizer.from_file(WORD)
    out = packing.pack(packing.pieces(docs, WORD, with_ids=True)).collect()
    want = []
    for i, t, _ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(-1 if i is None else i, k, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    bins = defaultdict(list)
    for r in out:
        assert zlib.crc32(r.ids) == r.ids_crc32
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        end = 0
        for offset, n in sorted(own):
            assert offset == end
            end += n
        assert end <= 2048
    assert len(bins) <= -(-sum(r.length for r in out) // 2048) + 1
    assert packing.pack(packing.pieces(docs.where("false"), WORD)).count() == 0


def test_digests(spark, tmp_path):
    spark.createDataFrame([(1, "Abc def"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    a, b = bpe.op2_bpe_tree(spark, str(tmp_path)).orderBy("doc_id").collect()
    ids = Tokenizer.from_file(BYTE).encode("Abc def", add_special_tokens=False).ids
    assert (a.n_tokens, a.ids_sha256, a.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(b"Abc def").hexdigest())
    assert (b.n_tokens, b.ids_sha256) == (0, hashlib.sha256(b"").hexdigest())


def test_workers_keep_no_words_after_a_task(spark):
    docs = spark.createDataFrame([(i, f"word{i} other{i} third") for i in range(40)], "doc_id long, text string").repartition(4)
    assert packing.pieces(docs, WORD).count() == 40

    def kept(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(packing.words(WORD).kept)], pa.int64())], ["n"])

    assert {r.n for r in spark.range(0, 4, 1, 4).mapInArrow(kept, "n long").collect()} == {0}

"""Quality classifier by nearest-neighbour voting.

Terms of a text are its words (hashed), the shapes of its words (case, length, what they
end in) and how much words and lines repeat. A bounded sample of labelled texts gives
their weights and, by a truncated SVD, a latent space. The sample's vectors are
broadcast; every text is projected, its cosine with all of them is computed in blocks,
and the labels of the nearest vote in proportion to a power of their similarity.

The share of votes is made a score by two straight lines that meet at CUT: the share that
tells the labels apart best when each text of the sample is judged by the others becomes
CUT, so that a score below CUT means that label 0 is likelier with both labels alike.

Defined results: a text without words is like nothing and gets the share of label 1 among
all labels given (0.5 without any); the same holds for all texts if no labelled text has
words. Null labels are not learned from; of rows that share a labelled id the text with the
least hash is learned from; repeated rows are each scored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .bpe import groups
from .common import held_out, lean, table

#: Labelled texts learned from, by label; latent dimensions; voters; power of the similarity.
SAMPLE, RANK, VOTERS, POWER = 1500, 48, 25, 6
#: The score from which a text counts as label 1.
CUT = 0.3
_HASHED, _SHAPES, _REPEATS = 1024, 80, 24
TERMS = _HASHED + _SHAPES + _REPEATS
_SYMBOLS = frozenset("#*$%&|<>")


def _shape(word: str) -> int:
    core = word.strip("!.,;:?#*$%&|<>()[]\"'")
    case = 4 if not core else 3 if core.isdigit() else 0 if core.islower() else 2 if core.isupper() and len(core) > 1 else 1 if core[:1].isupper() else 4
    tail = 3 if word[-1] in _SYMBOLS else 2 if word.endswith("!!") else 1 if not word[-1].isalnum() else 0
    return (case * 4 + tail) * 4 + (0 if len(word) <= 3 else 1 if len(word) <= 8 else 2 if len(word) <= 20 else 3)


class _Terms(dict):
    """Two term numbers of a word in one integer."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        core = word.strip("!.,;:?#*$%&|<>()[]\"'").lower()
        self[word] = out = zlib.crc32(core.encode()) % _HASHED * _SHAPES + _shape(word)
        return out


class Features:
    def __init__(self):
        self.of = _Terms()

    def __call__(self, texts: list[str]) -> np.ndarray:
        """Non-negative term weights; each of the three blocks has length 1 or 0."""
        out = np.zeros((len(texts), TERMS), dtype=np.float32)
        for i, t in enumerate(texts):
            tf = Counter(t.split())
            if not tf:
                continue
            code = np.fromiter(map(self.of.__getitem__, tf), dtype=np.int64, count=len(tf))
            n = np.fromiter(tf.values(), dtype=np.float64, count=len(tf))
            out[i, :_HASHED] = np.bincount(code // _SHAPES, weights=np.log1p(n), minlength=_HASHED)
            out[i, _HASHED : _HASHED + _SHAPES] = np.sqrt(np.bincount(code % _SHAPES, weights=n, minlength=_SHAPES))
            lines = [x for x in t.split("\n") if x]
            for at, r in ((0, n.sum() / len(n)), (12, len(lines) / max(1, len(set(lines))))):
                level = min(10.99, 2 * np.log2(max(1.0, r)))
                low = int(level)
                out[i, _HASHED + _SHAPES + at + low : _HASHED + _SHAPES + at + low + 2] = 1 - (level - low), level - low
        for a, b in ((0, _HASHED), (_HASHED, _HASHED + _SHAPES), (_HASHED + _SHAPES, TERMS)):
            out[:, a:b] /= np.maximum(np.sqrt((out[:, a:b] ** 2).sum(axis=1, keepdims=True)), 1e-9)
        return out


class Model:
    """Weights, latent axes, and the sample's unit vectors with their labels."""

    def __init__(self, x: np.ndarray, y: np.ndarray, prior: float = 0.5, rank: int = RANK):
        self.prior = prior
        df = (x > 0).sum(axis=0)
        self.weight = np.log((1 + len(x)) / (1 + df)).astype(np.float32)
        self.weight[_HASHED:] = 1
        self.axes = np.zeros((TERMS, 1), dtype=np.float32)
        if len(x):
            v = x * self.weight
            values, axes = np.linalg.eigh((v.T @ v).astype(np.float64))
            self.axes = axes[:, np.argsort(-values)[: min(rank, len(x))]].astype(np.float32)
        self.sample, ok = self.project(x)
        self.sample, self.label = self.sample[ok], y[ok].astype(np.float64)
        self.cut = best_cut(self.votes(self.sample, others=True), self.label)

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = (x * self.weight) @ self.axes
        n = np.sqrt((z**2).sum(axis=1, keepdims=True))
        return z / np.maximum(n, 1e-9), n[:, 0] > 1e-6

    def votes(self, z: np.ndarray, others: bool = False) -> np.ndarray:
        """The share of votes for label 1 for unit vectors, NaN where nothing is similar.
        others: z is the sample, and no text votes on itself."""
        out, k = np.full(len(z), np.nan), min(VOTERS, len(self.label) - others)
        if k < 1:
            return out
        for a in range(0, len(z), 256):
            cos = z[a : a + 256] @ self.sample.T
            if others:
                cos[np.arange(len(cos)), a + np.arange(len(cos))] = -2
            top = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(cos, top, 1), 0).astype(np.float64) ** POWER
            total = w.sum(axis=1)
            share = (w * self.label[top]).sum(axis=1) / np.maximum(total, 1e-12)
            out[a : a + 256] = np.where(total > 1e-12, share, np.nan)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        z, ok = self.project(x)
        share = np.where(ok, self.votes(z), np.nan)
        out = np.interp(share, [0, self.cut, 1], [0, CUT, 1])
        return np.where(np.isnan(share), self.prior, out)


def best_cut(share: np.ndarray, label: np.ndarray) -> float:
    """Where to part the shares, so that the sum of both labels' parts on the right side is
    largest; the middle of the widest of equally good gaps. CUT if there is one label only."""
    ok = ~np.isnan(share)
    share, label = share[ok], label[ok]
    if not len(label) or label.min() == label.max():
        return CUT
    by = np.argsort(share, kind="stable")
    share, label = share[by], label[by]
    good = np.cumsum(label == 0) / (label == 0).sum() - np.cumsum(label == 1) / (label == 1).sum()
    gap = np.append(share[1:], 1.0) - share
    good[gap <= 0] = -1
    best = np.flatnonzero(good >= good.max() - 1e-12)
    i = best[gap[best].argmax()]
    return float(np.clip(share[i] + gap[i] / 2, 1e-3, 1 - 1e-3))


def fit(docs: DataFrame, labels: DataFrame, *, label_column: str = "quality", id_column: str = "doc_id", text_column: str = "text", sample: int = SAMPLE) -> Model:
    """From `sample` labelled documents a label at most, chosen by a hash of the id."""
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)").distinct()
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two rows
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "id")  # at most 2 * sample rows are broadcast
    found = found.groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("label", F.col("t.text").alias("text"))

    @lean
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Features()
        for batch in batches:
            for at, part in groups(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(at, len(part)), pa.array([x.tobytes() for x in own(part)], pa.binary())], ["label", "x"])

    got = found.mapInArrow(local, "label int, x binary").collect()  # a row for each chosen id and label
    rows = sorted((bytes(r["x"]), r["label"]) for r in got)
    x = np.frombuffer(b"".join(r[0] for r in rows), dtype=np.float32).reshape(-1, TERMS)
    return Model(x, np.array([r[1] for r in rows], dtype=np.int64), prior)


def score(docs: DataFrame, model: Model, *, text_column: str = "text", keep: tuple[str, ...] = ("doc_id",), score_column: str = "score") -> DataFrame:
    """The columns to keep, and the score."""
    known = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 * SAMPLE vectors and TERMS x RANK weights

    @lean
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Features()
        for batch in batches:
            kept = batch.column(0).flatten()
            for at, part in groups(batch.column(1)):
                out = [*(c.slice(at, len(part)) for c in kept), pa.array(known.value.score(own(part)))]
                yield pa.RecordBatch.from_arrays(out, [*keep, score_column])

    rows = docs.select(F.struct(*keep).alias("kept"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(local, StructType([*(docs.schema[c] for c in keep), StructField(score_column, DoubleType())]))


def op1_neighbour_vote(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score(docs, fit(docs, labels.where(~held_out("doc_id", 5, 0))))
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))

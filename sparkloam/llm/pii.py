"""Personal data by weak supervision.

Fixed patterns give the base spans. Beyond them, long tokens of letters and digits are
candidates for secrets. Labelers vote on each: a pattern of known key formats, a
gazetteer of words that announce a secret, the punctuation around, and the mix of
characters. The corpus's candidates are counted by votes and features, a fixed number of
combinations; expectation-maximisation estimates from them how reliable each labeler is,
and its posteriors train the final classifier of spans, a logistic one whose weights
become a Spark expression.

Places of matches follow from the lengths of matches and of the text between them, so
all stays in DataFrame expressions. Patterns are possessive and start only where a match
can, which gives the same matches in linear time and without deep recursion.

A labeler sees the CONTEXT characters before a candidate and two after it.

Defined results: null counts as empty; places are code points, ends exclusive; repeated
rows give repeated results; without candidates the labelers keep their first
reliabilities; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone", "secret")
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Whole runs of 12 to 19 digits; shorter or longer runs fail anyway.
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{16,}+",
}
#: Words that announce a secret.
GAZETTEER = ("token", "key", "apikey", "api_key", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential", "credentials")
_BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_LABELERS = 4
#: Characters before a candidate that labelers see.
CONTEXT = 32
#: First reliabilities of the labelers, first share of secrets among candidates.
RELIABLE, SHARE = 0.8, 0.3


def _luhn(digits: str) -> str:
    n = f"length({digits})"
    digit = f"int(substring({digits}, {n} - i, 1))"
    return f"aggregate(sequence(0, {n} - 1), 0, (a, i) -> a + CASE WHEN i % 2 = 0 THEN {digit} WHEN {digit} > 4 THEN {digit} * 2 - 9 ELSE {digit} * 2 END) % 10 = 0"


def _valid(kind: str) -> str:
    if kind == "email":
        return "true"
    if kind == "ip":
        return rf"m.v RLIKE r'^{_BYTE.replace('0*+', '0*')}(?:\.{_BYTE.replace('0*+', '0*')}){{3}}$'"
    digits = "regexp_replace(m.v, '[^0-9]', '')"
    if kind == "phone":
        return f"length({digits}) BETWEEN 9 AND 15"
    return f"element_at(transform(array({digits}), d -> {_luhn('d')}), 1)"


def _matches(kind: str, left: int = 0) -> str:
    """Array of (s, e, v, before, after) for all matches of a kind in column t."""
    p = _PATTERNS[kind]
    around = f", 'before', right(z.g[i - 1], {left}), 'after', left(z.g[i], 2)" if left else ""
    one = f"named_struct('s', a.p + length(z.g[i - 1]), 'e', a.p + length(z.g[i - 1]) + length(z.m[i - 1]), 'v', z.m[i - 1]{around})"
    kinds = "array<struct<s:int,e:int,v:string" + (",before:string,after:string" if left else "") + ">>"
    return f"""element_at(transform(array(named_struct('m', regexp_extract_all(t, r'{p}', 0), 'g', split(t, r'{p}', -1))), z ->
        CASE WHEN size(z.m) = 0 THEN CAST(array() AS {kinds}) ELSE aggregate(sequence(1, size(z.m)),
          named_struct('p', 0, 'r', CAST(array() AS {kinds})),
          (a, i) -> named_struct('p', a.p + length(z.g[i - 1]) + length(z.m[i - 1]), 'r', CAST(a.r || array({one}) AS {kinds})),
          a -> a.r) END), 1)"""


def _signs(m: str) -> tuple[list[str], list[str]]:
    """Votes (-1, 0, 1) and features of a candidate as SQL."""
    share = f"length(regexp_replace({m}.v, '[^0-9]', '')) / length({m}.v)"
    words = "|".join(GAZETTEER)
    votes = [
        rf"CASE WHEN {m}.v RLIKE r'^(?:[0-9a-f]{{32,}}|[0-9A-F]{{32,}}|(?:sk|pk|ghp|xox[bp])[_-]\w{{16,}}|AKIA[0-9A-Z]{{12,}})$' THEN 1 WHEN {m}.v RLIKE r'^[A-Za-z]+[0-9]{{1,4}}$' THEN -1 ELSE 0 END",
        rf"CASE WHEN lower({m}.before) RLIKE r'(?:^|[^a-z])(?:{words})[^a-z]{{0,6}}$' THEN 1 ELSE 0 END",
        rf"CASE WHEN {m}.before RLIKE r'[=:]\s*[\x22\x27]?$' THEN 1 WHEN {m}.before RLIKE r'[A-Za-z,.]\s$' THEN -1 ELSE 0 END",
        f"CASE WHEN {share} BETWEEN 0.2 AND 0.9 THEN 1 ELSE -1 END",
    ]
    features = [f"CASE WHEN length({m}.v) < 20 THEN 0 WHEN length({m}.v) < 32 THEN 1 ELSE 2 END", f"CASE WHEN {share} < 0.2 THEN 0 WHEN {share} < 0.5 THEN 1 WHEN {share} < 0.8 THEN 2 ELSE 3 END"]
    return votes, features


def _rows(docs: DataFrame, text_column: str, keep: tuple[str, ...]) -> DataFrame:
    return docs.select(*keep, F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("t"))


def _design(signs: np.ndarray) -> np.ndarray:
    """One column for each value of each vote and feature, and one for the constant."""
    out = [np.ones(len(signs))]
    for k in range(_LABELERS):
        out += [signs[:, k] == v for v in (-1, 0, 1)]
    out += [signs[:, _LABELERS] == v for v in range(3)]
    out += [signs[:, _LABELERS + 1] == v for v in range(4)]
    return np.stack(out, 1).astype(float)


def learn(docs: DataFrame, *, text_column: str = "text", rounds: int = 50) -> np.ndarray:
    """Weights of the span classifier, from the candidates of all documents."""
    votes, features = _signs("m")
    names = [f"s{i}" for i in range(len(votes) + len(features))]
    found = _rows(docs, text_column, ()).select(F.explode(F.expr(_matches("secret", CONTEXT))).alias("m"))
    # At most 3 ** 4 * 12 rows.
    rows = found.select(*(F.expr(x).alias(c) for x, c in zip(votes + features, names))).groupBy(*names).agg(F.count("*").alias("n")).collect()
    signs = np.array([[r[c] for c in names] for r in rows], dtype=int).reshape(-1, len(names))
    count = np.array([r["n"] for r in rows], dtype=float)
    # Every combination counts a little, so that few candidates leave the first reliabilities in place.
    every = np.array(list(itertools.product(*[(-1, 0, 1)] * _LABELERS, range(3), range(4))))
    signs, count = np.concatenate([signs, every]), np.concatenate([count, np.full(len(every), 0.02)])
    miss = (1 - RELIABLE) / 2
    says = {c: np.array([[RELIABLE if v == (1 if c else -1) else miss for v in (-1, 0, 1)]] * _LABELERS) for c in (0, 1)}
    share, at = SHARE, signs[:, :_LABELERS] + 1
    for _ in range(rounds):
        log = {c: sum(np.log(says[c][k, at[:, k]]) for k in range(_LABELERS)) for c in (0, 1)}
        p = 1 / (1 + np.exp(np.clip(log[0] + math.log(1 - share) - log[1] - math.log(share), -50, 50)))
        share = float(np.clip((p * count).sum() / count.sum(), 0.01, 0.99))
        for c, w in ((0, (1 - p) * count), (1, p * count)):
            for k in range(_LABELERS):
                got = np.bincount(at[:, k], weights=w, minlength=3) + 0.5
                says[c][k] = got / got.sum()
    x, w = _design(signs), np.zeros(_design(signs).shape[1])
    for _ in range(60):  # Newton's method with a small penalty
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        d = np.maximum(q * (1 - q), 1e-6) * count
        w -= np.linalg.solve((x * d[:, None]).T @ x + np.eye(len(w)) * 0.1, x.T @ ((q - p) * count) + 0.1 * w)
    return w


def _score(m: str, weights: np.ndarray) -> str:
    votes, features = _signs(m)
    w = iter(weights.tolist())
    parts = [repr(next(w))]
    for x, values in [*((v, (-1, 0, 1)) for v in votes), (features[0], range(3)), (features[1], range(4))]:
        parts.append(f"CASE {x} " + " ".join(f"WHEN {v} THEN {next(w)!r}D" for v in values) + " END")
    return " + ".join(parts)


def spans(docs: DataFrame, weights: np.ndarray, *, text_column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep, t (the text), base and found: arrays of (s, k, e), by place and
    then kind; k numbers KINDS."""
    out = _rows(docs, text_column, keep)
    kinds = "array<struct<s:int,k:int,e:int>>"
    base = [f"transform(filter({_matches(k)}, m -> {_valid(k)}), m -> named_struct('s', m.s, 'k', {i}, 'e', m.e))" for i, k in enumerate(KINDS[:4])]
    more = f"filter({_matches('secret', CONTEXT)}, m -> {_score('m', weights)} >= 0)"
    out = out.select(*keep, "t", F.expr(f"CAST(array_sort(concat({', '.join(base)})) AS {kinds})").alias("base"), F.expr(f"transform({more}, m -> named_struct('s', m.s, 'k', 4, 'e', m.e))").alias("more"))
    added = "filter(more, m -> NOT exists(base, b -> b.s < m.e AND m.s < b.e))"
    return out.select(*keep, "t", "base", F.expr(f"CAST(array_sort(concat(base, {added})) AS {kinds})").alias("found"))


def listed(column: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({column}, x -> concat(array({names})[x.k], ':', x.s, ':', x.e)), ',')")


def masked() -> Column:
    """t with every span of found replaced by its kind in brackets."""
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    return F.expr(f"""CASE WHEN size(found) = 0 THEN t ELSE aggregate(found, named_struct('p', 0, 'o', CAST(array() AS array<string>)),
        (a, x) -> named_struct('p', greatest(a.p, x.e), 'o', CASE WHEN x.s < a.p THEN a.o ELSE a.o || array(substring(t, a.p + 1, x.s - a.p), array({names})[x.k]) END),
        a -> concat(array_join(a.o, ''), substring(t, a.p + 1))) END""")


def op7_weak_pii(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = spans(docs, learn(docs))
    many = (F.expr(f"size(filter(base, x -> x.k = {i}))").cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:4]))
    all_ = F.size("found").cast("long").alias("n_spans")
    return out.select("doc_id", *many, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("found").alias("spans"), all_)

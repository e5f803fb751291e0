"""Quality rules: a table of thresholds compiled into one projection.

Every statistic and rule is a Spark expression over the row's own text; nothing is
shuffled and no user function runs. Three-word windows are compared by sorting one
array of longs a text: the upper bits are a hash of the window, the lower ones its
place, so equal windows stand side by side; neighbours with equal hashes are then
compared word by word, and where their words differ, with all windows of that hash.

Defined results: a null text has no words; texts without words have zero statistics
and fail the base rule; repeated rows give repeated results; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, table

#: Frequent function words of four languages.
STOP_WORDS = (
    "the of and to in is that it for was on are with as be by this from at or an "
    "de la le les et des que en un une du pour qui dans est pas sur par au "
    "der die und das den von zu mit sich ist nicht ein eine dem im auf für "
    "el los las se del por con para como más su lo y a"
).split()


#: The hash of the three-word window that starts at word i.
HASH = "xxhash64(w[i], w[i + 1], w[i + 2])"


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= expression <= high; None leaves a side open."""

    name: str
    expression: str
    low: float | None = None
    high: float | None = None


#: Ratios are of the statistics in `statistics`; texts without words have no ratio and pass.
RULES = (
    Rule("mean word length", "word_chars / n_words", 2, 25),
    Rule("symbols a word", "n_symbols / n_words", None, 1.5),
    Rule("repeated lines", "n_dup_lines / n_lines", None, 0.5),
    Rule("distinct stop words", "n_stop_words", 2, None),
)


def statistics(docs: DataFrame, *, text_column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words and
    n_repeat_words beside the columns to keep."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    alike = "((x ^ {y}) & ~m) = 0"
    words = " AND ".join(f"w[int(x & m) + {j}] = w[int({{y}} & m) + {j}]" for j in range(3))
    before, after = "k > 0 AND " + alike.format(y="s[k - 1]"), "k < size(s) - 1 AND " + alike.format(y="s[k + 1]")
    met = f"({before} AND {words.format(y='s[k - 1]')}) OR ({after} AND {words.format(y='s[k + 1]')})"
    other = f"(({before}) OR ({after})) AND exists(s, y -> y <> x AND {alike.format(y='y')} AND {words.format(y='y')})"
    repeats = f"""
        CASE WHEN size(w) < 3 THEN 0L ELSE aggregate(
          element_at(transform(array(sort_array(transform(sequence(0, size(w) - 3), i -> ({HASH} & ~m) | bigint(i)))),
            s -> sort_array(transform(filter(s, (x, k) -> {met} OR ({other})), x -> x & m))), 1),
          named_struct('last', -3L, 'n', 0L),
          (a, p) -> named_struct('last', p, 'n', a.n + least(3L, p - a.last)),
          a -> a.n) END"""
    rows = docs.select(*keep, F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("t"))
    rows = rows.select(*keep, "t", F.expr(rf"array_remove(split(t, r'[{WS}]+'), '')").alias("w"), F.expr(r"filter(split(t, '\n'), l -> btrim(l, ' \t\n\u000B\f\r') <> '')").alias("lines"))
    return rows.select(
        *keep,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", f"[{WS}]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"size(array_intersect(w, array({stop})))").cast("long").alias("n_stop_words"),
        F.expr(f"element_at(transform(array(shiftleft(1L, int(ceil(log2(greatest(size(w), 2))))) - 1L), m -> {repeats}), 1)").alias("n_repeat_words"),
    )


def passes(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one condition."""
    out = F.lit(True)
    for r in rules:
        value = F.expr(f"CASE WHEN n_words > 0 AND n_lines > 0 THEN {r.expression} END")
        if r.low is not None:
            out = out & (F.coalesce(value, F.lit(float(r.low))) >= r.low)
        if r.high is not None:
            out = out & (F.coalesce(value, F.lit(float(r.high))) <= r.high)
    return out


def judge(stats: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds base_failed and kept."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~failed & passes(rules))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judge(statistics(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
x AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM x WHERE len(w) >= 3),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM g),
p AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM h WHERE c > 1) GROUP BY r),
s AS (SELECT x.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        len(list_intersect(list_distinct(w), [{", ".join(f"'{w}'" for w in STOP_WORDS)}])) AS n_stop_words,
        coalesce(p.n, 0)::BIGINT AS n_repeat_words FROM x LEFT JOIN p USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(f"{r.expression.replace(' / ', '::DOUBLE / ')} {op} {v}" for r in RULES for op, v in ((">=", r.low), ("<=", r.high)) if v is not None)} AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
"""

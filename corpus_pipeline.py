"""From documents to packed training sequences: rejected documents go, one of each group
of near copies stays, repeated passages and personal data are taken out, the rest is packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloam.llm import classifier, jaccard, packing, pii, suffixes
from sparkloam.llm.common import WS, held_out, row_key, stored, table


def _with_text(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """docs's rows in column row, with the text and n_chars as column text now has it."""
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return changed.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score below 0.3.

    Defined results: null and empty texts, and those without words, score the share of good
    ones among the labels; repeated rows are each judged; an empty table gives no rows.
    """
    model = classifier.fit(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0)))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    found = classifier.score(rows, model, keep=("row",))
    return found.where(F.col("score") >= classifier.CUT).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of the documents linked by shingles of 5 words at 0.8 or more, the one with the
    smallest id, and every row without words as it is.

    Defined results: of rows with the same id and text, which are copies, any one stays; a
    null id counts as larger than any other; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    worded = text.rlike(f"[^{WS}]")
    found = jaccard.join(docs.where(worded), n=5, num=80, den=100)
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "rk")).alias("r"))
    first = first.select(F.col("r.doc_id").alias("id"), F.col("r.rk").alias("rk"))
    rows = docs.where(worded).select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("own"), row_key("doc_id", text).alias("own_rk"))
    one = rows.join(first, (F.col("own_rk") == F.col("rk")) & F.col("own").eqNullSafe(F.col("id")))
    return one.dropDuplicates(["own_rk", "own"]).select("row.*").unionByName(docs.where(~worded))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every byte out that a string of 200 bytes covers which starts elsewhere, too.

    That is fifty words of three letters with their blanks, so that a passage of more words is
    long enough. Defined results: null texts become empty; shorter texts stay as they are; a character of
    which a part goes, goes; repeated rows lose all windows they share.
    """
    out = suffixes.dedup(docs, size=suffixes.PASSAGE, rest=tuple(c for c in docs.columns if c != "text"), as_text=True)
    return _with_text(out.select(F.col("rest").alias("row"), F.col("kept").alias("text")), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in place of every span.

    Defined results: null texts become empty; repeated rows give repeated results.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    out = pii.spans(rows, pii.learn(docs), keep=("row",))
    return _with_text(out.select("row", pii.masked().alias("text")), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences.

    Defined results: null and empty texts have one piece that holds the end id only.
    """
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality", quality), ("near_copies", near_copies), ("repeats", repeats), ("personal_data", personal_data), ("packed", packed)]

#: SQL cannot express the classifier, the tokenizer or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs

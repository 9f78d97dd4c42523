"""The operators as stages: documents in, documents out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plaudit.llm.common import row_ident, table
from plaudit.llm.minhash import representatives
from plaudit.llm.mixing import mixed, source_key
from plaudit.llm.packing import packed
from plaudit.llm.toxicity import THRESHOLD, scored, train

# Word shingles of the near-duplicate stage.
SHINGLE_WORDS = 5


def without_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; null texts stay."""
    weights = train(docs, table(spark, folder, "labels"))
    score = "_score"
    while score in docs.columns:
        score += "_"
    return scored(docs, weights, score).where(F.col(score) < THRESHOLD).drop(score)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id, any before null.

    A row goes only if its own text's group has another document that stays. Rows of the same doc_id and
    text are one document, of which one row stays; rows that share a doc_id only are not. Texts without
    words are copies of nothing and all stay.
    """
    ident = "_ident"
    while ident in docs.columns:
        ident += "_"
    worded = F.coalesce(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    rows = docs.where(worded).withColumn(ident, row_ident())
    kept = representatives(rows.select("doc_id", "text", ident), ident, words=SHINGLE_WORDS)
    once = rows.join(kept, ident, "left_semi").dropDuplicates([ident]).select(*docs.columns)
    return once.unionByName(docs.where(~worded))


def mixed_to_weights(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every document as often as the mix takes it; those it does not take go.

    Rows of the same source, doc_id and text are one document, with the copies of all of them.
    """
    ident, source, copies = "_ident", "_source_key", "_copies"
    while {ident, source, copies} & set(docs.columns):
        ident, source, copies = ident + "_", source + "_", copies + "_"
    taken = mixed(docs).where("copies > 0").groupBy("source_key", "ident").agg(F.sum("copies").alias(copies))
    taken = taken.withColumnsRenamed({"source_key": source, "ident": ident})
    once = docs.withColumns({source: source_key(), ident: row_ident()}).dropDuplicates([source, ident])
    repeated = once.join(taken, [source, ident]).withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    return repeated.select(*docs.columns)


def into_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return packed(docs)

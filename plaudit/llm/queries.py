"""One query per operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plaudit.llm import sql
from plaudit.llm.alignment import aligned, link_counts, with_counts
from plaudit.llm.chats import TURN_SCHEMAS, calls_of_turns, linked_calls
from plaudit.llm.common import table
from plaudit.llm.cover_tree import threshold_links
from plaudit.llm.hilbert import nearest
from plaudit.llm.merkle import audited
from plaudit.llm.minhash import near_duplicates
from plaudit.llm.mixing import mixed
from plaudit.llm.packing import packed
from plaudit.llm.sharding import shard_by_bytes
from plaudit.llm.substrings import without_repeats
from plaudit.llm.templates import main_texts
from plaudit.llm.token_counts import token_counts
from plaudit.llm.toxicity import toxicity_scores
from plaudit.sources.shared import saved


def op1_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op2_minimax_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard_by_bytes(table(spark, folder, "documents"))


def op3_nnls_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"))


def op4_viterbi_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"))


def op5_weak_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_cover_tree(spark: SparkSession, folder: str) -> DataFrame:
    return threshold_links(table(spark, folder, "embeddings"))


def op7_template_removal(spark: SparkSession, folder: str) -> DataFrame:
    return main_texts(table(spark, folder, "pages"))


def op8_pareto_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixed(table(spark, folder, "documents")).drop("copies", "source_key", "ident")


def op9_hilbert_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"))


def op10_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    calls, results = calls_of_turns(table(spark, folder, "conversations"))
    return linked_calls(calls, results, TURN_SCHEMAS)


def op11_pointer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    rows = aligned(table(spark, folder, "documents"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    rows = saved(rows.withColumn("groups", digest).withColumnRenamed("groups", "groups_sha256"))
    return with_counts(rows, link_counts(rows))


def op12_difference_cover(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = without_repeats(table(spark, folder, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return audited(table(spark, folder, "documents"))


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_minimax_sharding": op2_minimax_sharding,
    "op3_nnls_packing": op3_nnls_packing,
    "op4_viterbi_counts": op4_viterbi_counts,
    "op5_weak_toxicity": op5_weak_toxicity,
    "op6_cover_tree": op6_cover_tree,
    "op7_template_removal": op7_template_removal,
    "op8_pareto_mixing": op8_pareto_mixing,
    "op9_hilbert_neighbours": op9_hilbert_neighbours,
    "op10_tool_calls": op10_tool_calls,
    "op11_pointer_alignment": op11_pointer_alignment,
    "op12_difference_cover": op12_difference_cover,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL = {
    "op1_minhash_dedup": sql.NEAR_DUPLICATES,
    "op6_cover_tree": sql.THRESHOLD_LINKS,
    "op8_pareto_mixing": sql.mixing(),
    "op12_difference_cover": sql.REPEATS,
    "op13_merkle_manifest": sql.MERKLE,
}

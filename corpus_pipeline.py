"""Documents to training sequences: toxic ones go, one of each group of near copies stays, sources
are mixed to their weights, and what is left is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plaudit.llm import stages
from plaudit.llm.common import table
from plaudit.sources.shared import saved

STAGES = [
    ("toxicity", stages.without_toxic),
    ("near_duplicates", stages.without_near_duplicates),
    ("mixing", stages.mixed_to_weights),
    ("packing", stages.into_sequences),
]

# A fitted classifier and a tokenizer are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each on all that the one before kept."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = saved(docs)
    return docs

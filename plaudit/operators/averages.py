"""Mean scores and mean helpfulness.

Each is one grouped aggregate. Spark combines partial sums in the map tasks, so a
key that holds a large share of the rows reaches the shuffle as one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plaudit.functions.scalars import int_div, int_mean
from plaudit.schema import LENGTH_STEP


def item_score(reviews: DataFrame) -> DataFrame:
    """Mean score per item."""
    return reviews.groupBy("item_id").agg(F.avg("score").alias("mean_score"))


def user_score(reviews: DataFrame) -> DataFrame:
    """Mean score given by each user."""
    return reviews.groupBy("user_id").agg(F.avg("score").alias("mean_score"))


def user_helpfulness(reviews: DataFrame) -> DataFrame:
    """Mean helpfulness per user: reviews without votes count as 0, the mean is truncated."""
    pct = F.coalesce("helpful_pct", F.lit(0))
    return reviews.groupBy("user_id").agg(int_mean(pct).cast("double").alias("help"))


def length_helpfulness(reviews: DataFrame) -> DataFrame:
    """Mean helpfulness of voted reviews per body-length class, shortest class first.

    The label carries the lower bound of its class: ``< 0`` covers 0 to 1023. Only the
    stored ``body_length`` is read, so a columnar source never opens the texts.
    """
    bucket = int_div(F.col("body_length"), F.lit(LENGTH_STEP).cast("bigint"))
    return (
        reviews.filter(F.col("helpful_pct").isNotNull())
        .groupBy(bucket.alias("bucket"))
        .agg(int_mean(F.col("helpful_pct")).alias("mean_help"))
        .orderBy("bucket")
        .select(
            F.concat(F.lit("< "), (F.col("bucket") * LENGTH_STEP).cast("string")).alias("length_class"),
            "mean_help",
        )
    )


def helpfulness_by_score(reviews: DataFrame, item: str | None = None) -> DataFrame:
    """Mean helpfulness of voted reviews per (item, score), or per score of one item."""
    voted = reviews.filter(F.col("helpful_pct").isNotNull())
    keys = ["item_id", "score"]
    if item is not None:
        voted = voted.filter(F.col("item_id") == item)
        keys = ["score"]
    return voted.groupBy(*keys).agg(int_mean(F.col("helpful_pct")).alias("mean_help"))

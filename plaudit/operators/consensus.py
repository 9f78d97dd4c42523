"""Lift a reviewer towards the readers' verdict on the score they gave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plaudit.functions.scalars import int_mean
from plaudit.operators.averages import helpfulness_by_score, user_helpfulness
from plaudit.operators.skew import hot_keys, split_join
from plaudit.sources.shared import saved


def _lifted(own: Column, group: Column) -> Column:
    return F.when(own < group, (own + group) / 2).otherwise(own)


def consensus_lift(reviews: DataFrame, item: str) -> DataFrame:
    """One row per review of ``item``: its author's helpfulness, lifted halfway to the mean
    of the reviews that gave the item the same score. Scores nobody voted on give no row."""
    chosen = reviews.filter(F.col("item_id") == item).select("item_id", "user_id", "score")
    # An item has few different scores: their means are one row, looked up where the reviews are,
    # and the reviews of a common score need not meet in one task.
    means = helpfulness_by_score(reviews.filter((F.col("item_id") == item) & F.col("score").isNotNull()))
    means = means.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("score", "mean_help"))).alias("means"))
    graded = (
        chosen.filter(F.col("score").isNotNull())
        .join(F.broadcast(means), "item_id")
        .select("user_id", F.try_element_at("means", F.col("score")).alias("mean_help"))
        .filter(F.col("mean_help").isNotNull())
    )
    # Only the item's reviewers are averaged, so other users' reviews end before the shuffle
    # where the list of reviewers is small, and before the aggregate anyhow.
    theirs = reviews.join(chosen.select("user_id").distinct(), "user_id", "left_semi")
    return graded.join(user_helpfulness(theirs), "user_id").select(
        "user_id", _lifted(F.col("help"), F.col("mean_help")).alias("lifted_help")
    )


def graded_reviews(reviews: DataFrame) -> DataFrame:
    """``user_id, mean_help``: for every review the mean helpfulness of its item's reviews with its score.

    The reviews of one (item, score) are dealt over as many tasks as they need, and the mean is
    repeated for each.
    """
    scored = reviews.filter(F.col("score").isNotNull())
    groups = saved(
        scored.groupBy("item_id", "score").agg(
            int_mean(F.col("helpful_pct")).alias("mean_help"), F.count(F.lit(1)).alias("n")
        )
    )
    keys = ["item_id", "score"]
    hot = hot_keys(groups.select(*keys, "n"))
    means = groups.filter(F.col("mean_help").isNotNull()).drop("n")
    return split_join(scored.select("user_id", *keys), means, keys, hot, ["user_id"]).select("user_id", "mean_help")


def consensus_rank(reviews: DataFrame) -> DataFrame:
    """Mean lifted helpfulness per user over all of their reviews, for every item at once.

    The lift depends only on the author and on the group mean, a whole percentage, so
    reviews are first counted per (user, group mean). That combines in the map tasks and
    leaves at most about a hundred rows per user before the second and third shuffle.
    """
    weights = graded_reviews(reviews).groupBy("user_id", "mean_help").agg(F.count(F.lit(1)).alias("n"))
    lifted = _lifted(F.col("help"), F.col("mean_help"))
    return (
        weights.join(user_helpfulness(reviews), "user_id")
        .groupBy("user_id")
        .agg((F.sum(lifted * F.col("n")) / F.sum("n")).alias("rank"))
    )

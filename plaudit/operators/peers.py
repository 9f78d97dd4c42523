"""Raise a user towards the more helpful users who score items the same way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plaudit.operators.agreement import HOT_ITEM_ENTRIES, Ledger, class_pairs, gaining_pairs, open_ledger
from plaudit.schema import PEER_THRESHOLD

WEIGHTS = ("divergence", "agreement")


def _lift(weight: str, degree: Column, gain: Column) -> Column:
    """Decimal, so that sums do not depend on their order and what is added can be taken
    back without a trace."""
    share = degree if weight == "divergence" else 1 - degree
    return (share * gain).cast("decimal(24,12)")


def peer_rank(
    reviews: DataFrame,
    weight: str = "agreement",
    threshold: float = PEER_THRESHOLD,
    hot_least: int = HOT_ITEM_ENTRIES,
    hot_count: int | None = None,
) -> DataFrame:
    """Helpfulness per user plus the mean weighted gain over agreeing, more helpful users.

    A peer is another user whose ``degree`` is at most ``threshold`` and whose helpfulness is
    higher. The gain is weighted by the degree itself (``divergence``) or by one minus the
    degree (``agreement``). Users without peers keep their helpfulness.
    """
    if weight not in WEIGHTS:
        raise ValueError(f"unknown weight: {weight}")
    ledger = open_ledger(reviews, True, hot_least, hot_count, by_latest=True)
    known = None if ledger.crowd is None else class_pairs(ledger.crowd, threshold, others=ledger.others)
    pairs = gaining_pairs(ledger, threshold, known)

    def terms(degree: Column) -> tuple[Column, Column]:
        peer = degree <= threshold
        lift = F.when(peer, _lift(weight, degree, F.col("gain")))
        none = F.lit(0).cast("decimal(24,12)")
        return F.coalesce(lift, none), F.when(peer, F.lit(1)).otherwise(F.lit(0)).cast("bigint")

    lift, peers = terms(F.col("degree"))
    if ledger.crowd is None:
        pairs = pairs.filter(F.col("degree") <= threshold)
    else:
        hot_lift, hot_peers = terms(F.col("hot_degree"))
        lift, peers = lift - hot_lift, peers - hot_peers
    gains = pairs.select(F.col("uid_1").alias("uid"), lift.alias("lift"), peers.alias("peers"))
    if ledger.crowd is not None:
        gains = gains.unionByName(_crowd_gains(ledger, known, weight, threshold))
    gains = gains.groupBy("uid").agg(F.sum("lift").alias("lift"), F.sum("peers").alias("peers"))
    raised = F.col("help") + F.col("lift").cast("double") / F.col("peers")
    return ledger.users.join(gains, "uid", "left").select(
        "user_id", F.when(F.col("peers") > 0, raised).otherwise(F.col("help")).alias("rank")
    )


def _crowd_gains(ledger: Ledger, known: DataFrame, weight: str, threshold: float) -> DataFrame:
    """Gains over all peers by hot items alone, worked out per (class, helpfulness)."""
    heads, others = (crowd.members.select("uid", "class_id", "help") for crowd in (ledger.crowd, ledger.others))
    tally = others.groupBy("class_id", "help").agg(F.count(F.lit(1)).cast("decimal(13,0)").alias("m"))
    reach = (
        known.withColumn("degree", F.col("hot_gap") / F.col("hot_n"))
        .filter(F.col("degree") <= threshold)
        .join(tally.withColumnsRenamed({"class_id": "class_2", "help": "help_2"}), "class_2")
        .groupBy("class_1", "degree", "help_2")
        .agg(F.sum("m").cast("decimal(13,0)").alias("m"))
    )
    lift = _lift(weight, F.col("degree"), F.col("help_2") - F.col("help_1")) * F.col("m")
    gains = (
        heads.select(F.col("class_id").alias("class_1"), F.col("help").alias("help_1"))
        .distinct()
        .join(reach, "class_1")
        .filter(F.col("help_2") > F.col("help_1"))
        .groupBy("class_1", "help_1")
        .agg(F.sum(lift).alias("lift"), F.sum("m").cast("bigint").alias("peers"))
    )
    return heads.withColumnsRenamed({"class_id": "class_1", "help": "help_1"}).join(
        gains, ["class_1", "help_1"]
    ).select("uid", "lift", "peers")

"""Predict scores from the users who agree exactly on every common item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plaudit.operators.agreement import HOT_ITEM_ENTRIES, class_pairs, neighbour_pairs, numbers_of, open_ledger
from plaudit.operators.skew import counts_of, dealt, hot_keys, in_pieces, split_join
from plaudit.schema import SUGGEST_THRESHOLD
from plaudit.sources.shared import saved

# Predictions of a class in a block.
OFFER_BLOCK = 1024
NEIGHBOURS = ("all", "multi", "overlap")


def suggest(
    reviews: DataFrame,
    neighbours: str = "all",
    exclude_seen: bool = False,
    threshold: float = SUGGEST_THRESHOLD,
    hot_least: int = HOT_ITEM_ENTRIES,
    users: DataFrame | None = None,
    hot_count: int | None = None,
) -> DataFrame:
    """Mean score per (user, item) over the reviews of the user's neighbours.

    A neighbour is another user with ``degree`` at most ``threshold``. ``all`` takes each one
    once, ``multi`` only those with more than one review, ``overlap`` weighs each by the
    number of review pairs on common items. Items the user already reviewed are kept unless
    ``exclude_seen``. ``users(user_id)`` asks for predictions for these users only; the result
    for everybody is users times items at worst.
    """
    if neighbours not in NEIGHBOURS:
        raise ValueError(f"unknown neighbours: {neighbours}")
    ledger = open_ledger(reviews, False, hot_least, hot_count)
    given = ledger.entries.select("uid", "item_id", "score", "n")
    if neighbours == "multi":
        several = ledger.users.filter(F.col("reviews") > 1).select("uid")
        given = given.join(several, "uid", "left_semi")

    def weight(degree: Column, overlap: Column) -> Column:
        share = overlap if neighbours == "overlap" else F.lit(1).cast("bigint")
        return F.when(degree <= threshold, share)

    # Names go in before neighbours' reviews multiply the rows, not after.
    names = ledger.users.select("uid", "user_id")
    chosen = numbers_of(ledger, users)
    known = None if ledger.crowd is None else class_pairs(ledger.crowd, threshold, chosen)
    pairs = neighbour_pairs(ledger, threshold, known, chosen).join(names.withColumnRenamed("uid", "uid_1"), "uid_1")
    full = weight(F.col("degree"), F.col("overlap"))
    if ledger.crowd is None:
        edges = pairs.select("user_id", "uid_2", full.alias("w"))
        result = _means(_votes(edges, given))
    else:
        zero = F.lit(0).cast("bigint")
        by_class = weight(F.col("hot_degree"), F.col("hot_overlap"))
        change = F.coalesce(full, zero) - F.coalesce(by_class, zero)
        edges = pairs.select("user_id", "uid_2", change.alias("w")).filter(F.col("w") != 0)
        agreeing = known.select(
            "class_1", "class_2", weight(F.col("hot_gap") / F.col("hot_n"), F.col("hot_overlap")).alias("w")
        ).filter(F.col("w").isNotNull())
        members = saved(ledger.crowd.members.select("uid", "class_id").join(names, "uid"))
        asked = members if chosen is None else members.join(chosen, "uid", "left_semi")
        result = _crowd_result(members, asked, agreeing, given, _votes(edges, given))
    if exclude_seen:
        seen = ledger.kept.select("user_id", "item_id")
        result = result.join(seen, ["user_id", "item_id"], "left_anti")
    return result


def _votes(edges: DataFrame, given: DataFrame) -> DataFrame:
    return edges.join(given.withColumnRenamed("uid", "uid_2"), "uid_2").select(
        "user_id", "item_id", "score", (F.col("w") * F.col("n")).alias("votes")
    )


def _means(votes: DataFrame, keys: tuple[str, ...] = ("user_id", "item_id")) -> DataFrame:
    mean = F.sum(F.col("score") * F.col("votes")) / F.sum("votes")
    return votes.groupBy(*keys).agg(mean.alias("predicted"))


def _crowd_result(members: DataFrame, asked: DataFrame, agreeing: DataFrame, given: DataFrame, changes: DataFrame) -> DataFrame:
    """Predictions for the users ``asked`` from all neighbours by hot items, less each user's own reviews,
    and for everybody from the votes that ordinary items change.

    What a class offers, and what it predicts, is worked out once for all its members. Items on which a
    user's votes differ from the class's are few, and only these are summed by user and item; all others
    are the class's predictions, which a user takes in lists and which are not shuffled any more.
    """
    # A key that is never null stands for the item, since reviews without one are predicted too.
    item = F.coalesce(F.concat(F.lit("i"), "item_id"), F.lit(""))
    given, changes = given.withColumn("item_id", item), changes.withColumn("item_id", item)
    key = ["class_id"]
    classed = given.join(members, "uid")
    own_offers = saved(classed.groupBy("class_id", "item_id", "score").agg(F.sum("n").alias("n")))
    giving = agreeing.withColumnRenamed("class_2", "class_id")
    offered = split_join(
        own_offers, giving, key, hot_keys(saved(counts_of(own_offers, key))), ["item_id", "score"], hot_keys(saved(counts_of(giving, key))), ["class_1"]
    )
    offers = saved(
        offered.groupBy(F.col("class_1").alias("class_id"), "item_id", "score").agg(F.sum(F.col("w") * F.col("n")).alias("votes"))
    )
    own = agreeing.filter(F.col("class_1") == F.col("class_2")).select(F.col("class_1").alias("class_id"), "w")
    own_votes = split_join(given.join(asked, "uid"), own, key, hot_keys(saved(counts_of(classed, key))), ["uid", "item_id"])
    columns = ["user_id", "item_id", "score", "votes"]
    changes = changes.select(columns).unionByName(own_votes.withColumn("votes", -F.col("w") * F.col("n")).select(columns))
    changes = saved(changes.groupBy("user_id", "item_id", "score").agg(F.sum("votes").alias("votes")))

    # Whole counts per score: taking a neighbour back out leaves no rounding behind.
    touched = saved(changes.select("user_id", "item_id").distinct().join(asked.select("user_id", "class_id"), "user_id"))
    pair = ["class_id", "item_id"]
    theirs = split_join(touched, offers, pair, hot_keys(saved(counts_of(touched, pair))), ["user_id"])
    changed = theirs.select(columns).unionByName(changes).groupBy("user_id", "item_id", "score").agg(F.sum("votes").alias("votes"))
    named = F.when(F.col("item_id") != "", F.expr("substring(item_id, 2)"))
    result = _means(changed.filter(F.col("votes") != 0)).withColumn("item_id", named)

    predicted = saved(_means(offers, ("class_id", "item_id")))
    hot = saved(in_pieces(counts_of(predicted, key), OFFER_BLOCK))

    def pieced(df: DataFrame, piece: Column) -> DataFrame:
        return df.join(F.broadcast(hot), "class_id", "left").withColumn("piece", piece).drop("pieces")

    pieces = F.coalesce("pieces", F.lit(1))
    lists = pieced(predicted, dealt(["item_id"], pieces)).groupBy("class_id", "piece").agg(
        F.collect_list(F.struct("item_id", named.alias("name"), "predicted")).alias("offer")
    )
    offer = {"items": "item_id", "names": "name", "means": "predicted"}
    lists = lists.select("class_id", "piece", *[F.col(f"offer.{c}").alias(name) for name, c in offer.items()])
    out = pieced(touched, dealt(["item_id"], pieces)).groupBy("user_id", "class_id", "piece").agg(F.collect_list("item_id").alias("out"))
    takers = pieced(asked.select("user_id", "class_id"), F.explode(F.sequence(F.lit(0), pieces - 1)))
    taken = takers.join(out, ["user_id", "class_id", "piece"], "left").join(lists, ["class_id", "piece"])
    taken = taken.select("user_id", "out", "names", "means", F.posexplode("items").alias("_at", "item"))
    untouched = taken.filter(~F.coalesce(F.array_contains("out", F.col("item")), F.lit(False)))
    own = {name: F.get(names, F.col("_at")).alias(name) for name, names in (("item_id", "names"), ("predicted", "means"))}
    return result.unionByName(untouched.select("user_id", *own.values()))

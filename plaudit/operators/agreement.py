"""How far two users agree on the items they both reviewed.

``degree`` of an ordered pair is the mean absolute difference between each of the first
user's scores and the second user's latest score on the same item. Only pairs with a common
item matter, so pairs come from an equi-join on the item, never from user x user.

An item with m reviewers makes m * m pairs. Most items are small and that is fine; for those
that hold a large share of all reviews it is not. The largest, *hot* items stay out of the join
(other large items are cut into slots); how many is decided by what either way costs. Users who treated every hot item alike
form one *class*, and agreement on hot items is worked out once per pair of classes. Results
for two users are then

* hot only: read off their classes, for whole classes at a time;
* with a common ordinary item as well: the pair is listed by the join, and its class figure
  is replaced by the true one.

Every pair is counted exactly once either way, so results do not depend on what is hot.

Where only exact agreement counts, pairs of classes are made by an equi-join on (item, score): a pair
that agrees on no hot item cannot pass. Bit masks of the hot items tell which of the other pairs
meet at all. Whole classes become pairs of users block by block, never members times members at once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from plaudit.functions.scalars import int_div
from plaudit.operators.averages import user_helpfulness
from plaudit.operators.skew import counts_of, dealt, hot_keys, in_pieces, split_join
from plaudit.schema import PEER_THRESHOLD
from plaudit.sources.shared import fresh_path, saved, scratch, stored

# An item is large from this many entries on (reviews, less repeats of a score by the same
# user); the ordinary join cuts it into slots of that size.
HOT_ITEM_ENTRIES = 2_048
# Slots of one item, beyond which it is hot whatever number of hot items is asked for: in the join its
# pairs of users would grow with the square of its entries.
MOST_SLOTS = 8
# Numbers of largest items that are weighed against each other as the hot ones.
HOT_COUNTS = (0, 1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096)
# Bits of a mask of hot items, and masks of a class. With more hot items some share a bit.
MASK_BITS = 64
MASKS = 4
# Records on one hot item that one task takes as first side when classes are matched.
CLASS_SLOT = 256
# Pairs on an item that one task adds up.
PAIRS_OF_TASK = 4_000_000
# Pairs, both directions counted, that edges for everybody shuffle at a time: what bounds the disk they take.
PAIRS_OF_ROUND = 400_000_000
# Reviews that one task reduces or joins; with more, the shuffle has more partitions than the session asks for.
REVIEWS_OF_TASK = 1_000_000
# What a pair is added up by; its share says which task does.
PAIR = ("uid_1", "share", "uid_2")
# Different scores up to which a score is one byte in the lists that pairs are made from.
SCORE_CODES = 127
# Members of a class in a block for making pairs of users.
MEMBER_BLOCK = 2_048


def user_items(reviews: DataFrame) -> DataFrame:
    """Every (user, item, score) with the number of reviews behind it."""
    return reviews.groupBy("user_id", "item_id", "score").agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class Crowd:
    """Classes of users alike on the hot items: ``members`` (uid, class_id, help if known, and ``masks`` with the
    bits of the hot items that the class knows, none if there is but one), ``lines`` (class_id, item_id, score, n, latest), what the classes say,
    and ``known`` (class_id, hots), the numbers of their hot items. ``exact`` if each has a bit of its own."""

    members: DataFrame
    lines: DataFrame
    known: DataFrame
    masks: list[str]
    exact: bool


@dataclass(frozen=True)
class Ledger:
    """What the reviews say, in the form that pairs are made from.

    ``kept`` (user_id, item_id, score, n, latest) has one row per score a user gave an item.
    ``users`` (uid, user_id, reviews, help) numbers the users, and ``entries`` are the kept
    rows with the number instead of the id. ``first`` and ``second`` are the entries on
    ordinary items, in the shape each side of a pair takes them. ``crowd`` are the classes of first
    users and ``others`` those of second ones, the same unless only latest scores are asked for.
    ``scores`` are all different scores, none if they are more than ``SCORE_CODES``.
    ``tasks`` is how many tasks their pairs are dealt over, by the number of pairs, and ``parts``
    how many partitions the entries need, by the number of reviews. ``rounds`` is in how many rounds
    pairs for everybody are shuffled.
    """

    kept: DataFrame
    users: DataFrame
    entries: DataFrame
    first: DataFrame
    second: DataFrame
    crowd: Crowd | None
    others: Crowd | None
    tasks: int
    parts: int
    scores: list[float]
    rounds: int


def open_ledger(
    reviews: DataFrame,
    with_help: bool = False,
    hot_least: int = HOT_ITEM_ENTRIES,
    hot_count: int | None = None,
    by_latest: bool = False,
) -> Ledger:
    """One pass over the reviews, written out small and by column; the rest reads that.

    ``hot_count`` of the large items are hot and all of more than ``MOST_SLOTS`` slots besides, or
    the number that costs least. Results are the same. ``by_latest`` is for totals without overlaps:
    second users are one class if their latest scores are alike, first users whatever is latest.
    """
    pct = F.coalesce("helpful_pct", F.lit(0)) if with_help else F.lit(0)
    spark = reviews.sparkSession
    path = fresh_path(spark, "table")
    # The reviews as they are go once they are summed up.
    with scratch(spark):
        narrow = saved(reviews.select("user_id", "item_id", "score", "review_time", pct.alias("pct")))
        parts = math.ceil(narrow.count() / REVIEWS_OF_TASK)
        # Dealt once, for the groups and for the window.
        scores = _spread(narrow, parts, ["user_id", "item_id"], always=True).groupBy("user_id", "item_id", "score").agg(
            F.count(F.lit(1)).alias("n"), F.max("review_time").alias("last"), F.sum("pct").alias("pct")
        )
        # A window of one user on one item: as many rows as there are different scores.
        newest = Window.partitionBy("user_id", "item_id").orderBy(
            F.col("score").isNull(), F.desc("last"), F.desc("score")
        )
        kept = stored(scores.withColumn("latest", F.row_number().over(newest) == 1).drop("last"), path)
    # Short numbers stand for user ids in all pairs. They are written out before use, since
    # they must not change when a lost task is run again.
    users = saved(
        kept.groupBy("user_id")
        .agg(
            F.sum("n").alias("reviews"),
            int_div(F.sum("pct"), F.sum("n")).cast("double").alias("help"),
        )
        .withColumn("uid", F.monotonically_increasing_id())
    )
    users = _without_gaps(users)
    numbers = users.select("user_id", "uid", *(["help"] if with_help else []))
    # A review whose score could not be read counts as a review of its user, but agrees with none.
    scored = kept.drop("pct").filter(F.col("score").isNotNull())
    # Read by every step from here on; as a join it would be shuffled for each of them.
    entries = saved(scored.join(numbers, "user_id").drop("user_id"))

    # Rows without an item meet no others.
    pairs = Observation()
    sizes = _sizes(scored.filter(F.col("item_id").isNotNull()))
    sizes = sizes.observe(pairs, F.sum(F.col("entries").cast("double") ** 2).alias("n"))
    large = saved(sizes.filter(F.col("entries") >= hot_least))
    most = max(HOT_COUNTS)
    top = large.orderBy(F.desc("entries"), "item_id").limit(most + 1).collect()
    if hot_count is None and top:
        squares = float(large.agg(F.sum(F.col("entries").cast("double") ** 2)).first()[0])
        hot_count = _cheapest(entries, top[:most], squares)
    elif hot_count is not None:
        hot_count = max(hot_count, sum(row.entries > MOST_SLOTS * hot_least for row in top[:most]))
    hot = [row.item_id for row in top[: hot_count or 0]]
    first = second = entries
    crowd = others = None
    if hot:
        is_hot = F.col("item_id").isin(hot)
        on_hot = entries.filter(is_hot)
        large = large.filter(~is_hot)
        crowd, others = _crowds(on_hot, hot, by_latest)
        ordinary = entries.filter(~is_hot)
        if by_latest:
            classes = crowd.members.drop("help").join(others.members.select("uid", F.col("class_id").alias("other_id")), "uid")
            # Written out, since the sides differ and would be joined twice.
            both = saved(ordinary.join(classes, "uid", "left"))
            first = both.drop("other_id")
            second = both.drop("class_id").withColumnRenamed("other_id", "class_id")
        else:
            first = second = ordinary.join(crowd.members.drop("help"), "uid", "left")
    if len(top) > len(hot):
        first, second = _gridded(first, second, large, hot_least)
    ordinary = (pairs.get["n"] or 0.0) - sum(float(row.entries) ** 2 for row in top[: len(hot)])
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(partitions, math.ceil(ordinary / PAIRS_OF_TASK))
    return Ledger(kept, users, entries, first, second, crowd, others, tasks, parts, _few_scores(scored), max(1, math.ceil(ordinary / PAIRS_OF_ROUND)))


def _spread(df: DataFrame, parts: int, keys: list[str], always: bool = False) -> DataFrame:
    """``df`` dealt by ``keys`` over ``parts`` partitions, where these are more than the session asks for,
    and else as it stands or, ``always``, over as many as the session asks for.

    Rows of one value of ``keys`` stay together: the caller keeps those few or reduces them as they come.
    """
    asked = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if parts > asked:
        return df.repartition(parts, *keys)
    return df.repartition(*keys) if always else df


def _few_scores(scored: DataFrame) -> list[float]:
    values = [row.score for row in scored.select("score").distinct().limit(SCORE_CODES + 1).collect()]
    # What is no number equals nothing, itself included.
    return sorted(values) if len(values) <= SCORE_CODES and all(v == v for v in values) else []


def _without_gaps(users: DataFrame) -> DataFrame:
    """Numbers from 0 on instead of those of ``monotonically_increasing_id``, which has the partition in its bits
    from the 34th and counts in the lower ones: half as long in every pair, up to two thousand million users."""
    part = F.call_function("shiftright", F.col("uid"), F.lit(33))
    counts = {row.part: row.n for row in counts_of(users.select(part.alias("part")), ["part"]).collect()}
    starts = [0]
    for k in range(max(counts, default=0)):
        starts.append(starts[-1] + counts.get(k, 0))
    number = F.get(F.lit(starts).cast("array<bigint>"), part.cast("int")) + F.col("uid").bitwiseAND((1 << 33) - 1)
    short = sum(counts.values()) < 1 << 31
    return users.withColumn("uid", number.cast("int" if short else "bigint"))


def _sizes(entries: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return entries.groupBy(*(keys or ["item_id"])).agg(F.count(F.lit(1)).alias("entries"))


def _cheapest(entries: DataFrame, top: list, squares: float) -> int:
    """How many of the ``top`` items, largest first, to take out of the join.

    An item in the join makes as many pairs as the square of its entries. A hot item makes pairs of
    the classes that know it instead: users alike on all hot items. Classes multiply with every further
    item, so their number is estimated for each candidate and item, in one pass over the top items' entries.
    """
    counts = [k for k in HOT_COUNTS if 0 < k < len(top)] + [len(top)]
    entry = F.struct("i", "score", "n", "latest")
    ranked = entries.join(_numbers(entries, top), "item_id")
    records = ranked.groupBy("uid").agg(F.sort_array(F.collect_list(entry)).alias("record"))

    def prefix(k: int) -> Column:
        return F.xxhash64(F.filter("record", lambda e: e["i"] < k)).alias(f"k{k}")

    lines = records.select(F.explode(F.array_distinct("record.i")).alias("i"), *map(prefix, counts))
    classes = lines.groupBy("i").agg(
        *[F.approx_count_distinct(F.when(F.col("i") < k, F.col(f"k{k}"))).alias(f"k{k}") for k in counts]
    )
    met = classes.agg(*[F.sum(F.col(f"k{k}").cast("double") ** 2).alias(f"k{k}") for k in counts]).first()
    sizes = [float(row.entries) ** 2 for row in top]
    costs = {0: squares} | {k: (met[f"k{k}"] or 0.0) + squares - sum(sizes[:k]) for k in counts}
    return min(costs, key=costs.get)


def _numbers(df: DataFrame, items: list) -> DataFrame:
    """``item_id, i`` of the ``items``, of which there are no more than the largest of ``HOT_COUNTS`` and one."""
    rows = [(item if isinstance(item, str) else item.item_id, i) for i, item in enumerate(items)]
    return F.broadcast(df.sparkSession.createDataFrame(rows, "item_id string, i int"))


def _slotted(
    first: DataFrame, second: DataFrame, large: DataFrame, least: int, keys: list[str], by: str
) -> tuple[DataFrame, DataFrame]:
    """Cut each large key into slots of about ``least`` entries on the first side and
    repeat the second side in every slot, so that no task meets a whole large item."""
    slots = large.select(*keys, F.ceil(F.col("entries") / least).alias("slots"))
    count = F.coalesce("slots", F.lit(1))
    first = first.join(slots, keys, "left").withColumn("slot", F.pmod(F.xxhash64(by), count))
    each = F.sequence(F.lit(0).cast("bigint"), count - 1)
    second = second.join(slots, keys, "left").withColumn("slot", F.explode(each))
    return first.drop("slots"), second.drop("slots")


def _gridded(first: DataFrame, second: DataFrame, large: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Cut each large item into a grid of slots of the first side and pieces of the second, of about
    ``least`` entries each."""
    slots = saved(large.select("item_id", F.ceil(F.col("entries") / least).alias("slots")))
    count = F.coalesce("slots", F.lit(1))
    own, each = F.pmod(F.xxhash64("uid"), count), F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1))

    def cut(side: DataFrame, slot: Column, piece: Column) -> DataFrame:
        joined = side.join(slots, "item_id", "left")
        return joined.withColumn("slot", slot).withColumn("piece", piece).drop("slots")

    return cut(first, own, each), cut(second, each, own)


def _crowds(entries: DataFrame, hot: list[str], by_latest: bool) -> tuple[Crowd, Crowd]:
    """Number the distinct hot-item records, of users as first and as second ones of a pair. A record is one
    user's scores of the hot items: all of them on both sides or, ``by_latest``, the latest on the second."""
    numbered = entries.join(_numbers(entries, hot), "item_id")
    one = F.lit(1).cast("bigint")

    def record(n: Column, latest: Column) -> Column:
        return F.struct("item_id", "score", n.alias("n"), latest.alias("latest"))

    if by_latest:
        sides = {"record": record(F.col("n"), F.lit(True)), "other": F.when(F.col("latest"), record(one, F.lit(True)))}
    else:
        sides = {"record": record(F.col("n"), F.col("latest"))}
    records = numbered.groupBy("uid").agg(
        *[F.sort_array(F.collect_list(entry)).alias(name) for name, entry in sides.items()],
        F.sort_array(F.collect_set("i")).alias("hots"),
        *([F.max("help").alias("help")] if "help" in entries.columns else []),
    )
    if by_latest:
        # Read by both sides.
        records = saved(records)

    def mask(j: int) -> Column:
        own = F.filter("hots", lambda i: F.floor(i / MASK_BITS) % MASKS == j)
        return F.aggregate(own, one - one, lambda bits, i: bits.bitwiseOR(F.call_function("shiftleft", one, i % MASK_BITS)))

    # Everybody in the crowd knows the only hot item.
    masks = [f"mask_{j}" for j in range(min(MASKS, -(-len(hot) // MASK_BITS)))] if len(hot) > 1 else []

    def crowd(name: str) -> Crowd:
        classes = records.select(F.col(name).alias("record"), "hots").distinct()
        classes = classes.withColumn("class_id", F.monotonically_increasing_id())
        classes = saved(classes.withColumns({name: mask(j) for j, name in enumerate(masks)}))
        own = records.drop(*(c for c in sides if c != name)).withColumnRenamed(name, "record")
        members = saved(own.join(classes, ["record", "hots"]).drop("record", "hots"))
        lines = saved(classes.select("class_id", F.inline("record")))
        return Crowd(members, lines, classes.select("class_id", "hots"), masks, len(hot) <= MASK_BITS * MASKS)

    first = crowd("record")
    return first, crowd("other") if by_latest else first


def class_pairs(
    crowd: Crowd, threshold: float, asked: DataFrame | None = None, others: Crowd | None = None
) -> DataFrame:
    """``class_1, class_2, hot_gap, hot_n, hot_overlap`` of pairs of classes with a common hot item.

    Where only exact agreement counts, these are the pairs that agree exactly, and the others are not
    made. ``asked(uid)`` limits the first classes to those of some users. Second classes are those of
    ``others``, if given.
    """
    own, theirs = crowd.lines, (others or crowd).lines
    if asked is not None:
        classes = crowd.members.join(asked, "uid", "left_semi").select("class_id").distinct()
        own = own.join(classes, "class_id", "left_semi")
    own, other = (side.withColumnRenamed("class_id", "uid") for side in (own, theirs))
    if threshold > 0:
        sizes = _sizes(crowd.lines)
        first, second = _slotted(own, other, sizes, CLASS_SLOT, ["item_id"], "uid")
        totals = _directed(first, second, with_overlap=True)
    else:
        alike = ["item_id", "score"]
        latest = other.filter("latest")
        first, second = _slotted(own, latest, _sizes(latest, alike), CLASS_SLOT, alike, "uid")
        close = first.select("uid", *alike, "slot").withColumnRenamed("uid", "class_1").join(
            second.select("uid", *alike, "slot").withColumnRenamed("uid", "class_2"), [*alike, "slot"]
        )
        close = close.select("class_1", "class_2").distinct()
        met = close.join(own.withColumnsRenamed({"uid": "class_1", "score": "score_1", "n": "n_1"}).drop("latest"), "class_1").join(
            other.withColumnsRenamed({"uid": "class_2", "score": "score_2", "n": "n_2", "latest": "latest_2"}), ["class_2", "item_id"]
        )
        totals = _totals(met.withColumnsRenamed({"class_1": "uid_1", "class_2": "uid_2"}), with_overlap=True)
        totals = totals.filter("gap = 0")
    names = {"uid_1": "class_1", "uid_2": "class_2", "gap": "hot_gap", "n": "hot_n", "overlap": "hot_overlap"}
    return saved(totals.select(*[F.col(c).alias(name) for c, name in names.items()]))


def _meet(first: DataFrame, second: DataFrame) -> DataFrame:
    keys = ["item_id", "slot"] if "slot" in first.columns else ["item_id"]

    def side(df: DataFrame, k: int) -> DataFrame:
        return df.withColumnsRenamed({c: f"{c}_{k}" for c in df.columns if c not in keys})

    return side(first, 1).join(side(second, 2), keys)


def _met_in_lists(ledger: Ledger, first: DataFrame, second: DataFrame, ahead: str | None = None) -> DataFrame:
    """The rows of :func:`_meet` dealt over tasks by ``uid_1``, and by a ``share`` that each pair has
    where there are heavy users, so that totals of pairs need no shuffle.
    With ``ahead`` only those whose second user has more of that column.

    The second side goes to the first users in lists of plain values, one list per column, and becomes
    rows in the task that adds them up. Lists are sorted by ``ahead``: those ahead are the head of a list.
    """
    lists, fields = _listed(ledger, second, ahead)
    keys = _cell_keys(second)
    own = {c: f"{c}_1" for c in first.columns if c not in keys}
    first = _spread(first.filter(F.col("item_id").isNotNull()), ledger.parts, keys)
    rows = first.withColumnsRenamed(own).join(lists, keys).drop(*keys)
    return _dealt_met(ledger, rows, fields, ahead, ledger.tasks, _heavy(ledger))


def _cell_keys(side: DataFrame) -> list[str]:
    return [c for c in ("item_id", "slot", "piece") if c in side.columns]


def _listed(ledger: Ledger, side: DataFrame, ahead: str | None) -> tuple[DataFrame, list[str]]:
    """The keys of ``side`` and a list per other column (``uid_2`` ...), sorted by ``ahead``; and these columns."""
    if ledger.scores:
        side = side.withColumn("score", (F.array_position(_scores(ledger), F.col("score")) - 1).cast("tinyint"))
    keys = _cell_keys(side)
    fields = [c for c in side.columns if c not in keys]
    fields.sort(key=lambda c: c != ahead)
    entries = F.collect_list(F.struct(*fields))
    # Large items are cut, so no key is heavy.
    side = _spread(side.filter(F.col("item_id").isNotNull()), ledger.parts, keys)
    lists = side.groupBy(*keys).agg(
        (F.sort_array(entries, asc=False) if ahead else entries).alias("entries")
    )
    return lists.select(*keys, *[F.col(f"entries.{c}").alias(f"{c}_2") for c in fields]), fields


def _scores(ledger: Ledger) -> Column:
    return F.lit(ledger.scores).cast("array<double>")


def _decoded(ledger: Ledger, score: Column) -> Column:
    return F.get(_scores(ledger), score.cast("int")) if ledger.scores else score


def _heavy(ledger: Ledger) -> DataFrame | None:
    """Users with a large share of all reviews, ``uid_1``; None if there are none."""
    heavy = hot_keys(ledger.users.select("uid", F.col("reviews").alias("n"))).select(F.col("uid").alias("uid_1"))
    return None if heavy.isEmpty() else heavy


def _dealt_met(
    ledger: Ledger, rows: DataFrame, fields: list[str], ahead: str | None, tasks: int, heavy: DataFrame | None
) -> DataFrame:
    """Pairs of the first users ``rows`` (``uid_1`` ...) with those in their lists of ``fields`` (``uid_2`` ...),
    a row each, in the task of the pair."""
    if ahead:
        rows = rows.withColumn("_n", F.size(F.filter(f"{ahead}_2", lambda value: value > F.col(f"{ahead}_1"))))
        rows = rows.filter("_n > 0").withColumns({f"{c}_2": F.slice(f"{c}_2", 1, F.col("_n")) for c in fields}).drop("_n")
    deal, lists = ["uid_1"], [f"{c}_2" for c in fields]

    def one_by_one(rows: DataFrame) -> DataFrame:
        once = [c for c in rows.columns if c not in lists]
        rows = rows.select(*rows.columns, F.posexplode("uid_2").alias("_at", "_uid"))
        return rows.select(*once, *[F.get(c, F.col("_at")).alias(c) for c in lists])

    # Users with a large share of all reviews have their pairs dealt over many tasks.
    if heavy is not None:
        theirs = one_by_one(rows.join(F.broadcast(heavy), "uid_1", "left_semi"))
        theirs = theirs.withColumn("share", dealt(["uid_2"], F.lit(tasks)))
        theirs = theirs.withColumns({c: F.array(c) for c in lists})
        rows = rows.join(F.broadcast(heavy), "uid_1", "left_anti").withColumn("share", F.lit(0)).unionByName(theirs)
        deal.append("share")
    met = one_by_one(rows.repartition(tasks, *deal))
    return met.withColumn("score_2", _decoded(ledger, F.col("score_2")))


def _gap() -> Column:
    return F.abs(F.col("score_1") - F.col("score_2"))


def _directed(
    first: DataFrame,
    second: DataFrame,
    with_overlap: bool = False,
) -> DataFrame:
    """Totals over the common items of each ordered pair."""
    return _totals(_meet(first, second), with_overlap)


def _totals(met: DataFrame, with_overlap: bool, **extra: Column) -> DataFrame:
    latest = F.col("latest_2")
    pair = [c for c in PAIR if c in met.columns]
    totals = met.groupBy(*pair).agg(
        F.sum(F.when(latest, F.col("n_1") * _gap()).otherwise(0.0)).alias("gap"),
        F.sum(F.when(latest, F.col("n_1")).otherwise(0)).alias("n"),
        *([F.sum(F.col("n_1") * F.col("n_2")).alias("overlap")] if with_overlap else []),
        *[value.alias(name) for name, value in extra.items()],
    )
    return totals.drop("share")


def _of_classes(crowd: Crowd | None) -> dict[str, Column]:
    """Aggregates of a pair that say which classes meet in it, and whether on a hot item."""
    if crowd is None:
        return {}
    common = F.lit(False) if crowd.masks else F.col("class_id_1").isNotNull() & F.col("class_id_2").isNotNull()
    for mask in crowd.masks:
        common = common | (F.coalesce(F.col(f"{mask}_1").bitwiseAND(F.col(f"{mask}_2")), F.lit(0)) != 0)
    return {"class_1": F.max("class_id_1"), "class_2": F.max("class_id_2"), "meets": F.max(common)}


def gaining_pairs(ledger: Ledger, threshold: float, known: DataFrame | None) -> DataFrame:
    """Pairs with a common ordinary item whose second user is the more helpful: uid_1, uid_2,
    ``gain``, ``degree`` and, with a crowd, ``hot_degree`` as their classes alone would have it.
    ``known`` are the pairs of classes.

    Half of all pairs, and every self-pair, end at the join.
    """
    gain = F.col("help_2") - F.col("help_1")
    classes = _of_classes(ledger.crowd)
    # Reviews before the latest count on the first side only.
    first, second = ledger.first.drop("latest"), ledger.second.filter("latest").drop("n", "latest")
    met = _met_in_lists(ledger, first, second, "help").withColumn("latest_2", F.lit(True))
    pairs = _totals(met, False, gain=F.max(gain), **classes)
    return _with_degree(pairs, threshold, known, ledger)


def numbers_of(ledger: Ledger, users: DataFrame | None) -> DataFrame | None:
    """The numbers of the users asked for, ``users(user_id)``; None for everybody."""
    if users is None:
        return None
    return saved(ledger.users.join(users.select("user_id"), "user_id", "left_semi").select("uid"))


def neighbour_pairs(
    ledger: Ledger, threshold: float, known: DataFrame | None, chosen: DataFrame | None = None
) -> DataFrame:
    """Pairs of different users with a common ordinary item: uid_1, uid_2, ``degree``,
    ``overlap`` and, with a crowd, ``hot_degree`` and ``hot_overlap`` by the pairs ``known`` of classes.
    Without a crowd only pairs up to ``threshold`` are given. With ``chosen(uid)`` only pairs whose
    first user is among them: the other first users end before the join, and so do second users'
    entries on items that none of the chosen has.

    For everybody, the join makes each pair once, and totals for both directions come out of
    the same row.
    """
    crowd = ledger.crowd
    if chosen is not None:
        first, second = asked_sides(ledger, chosen)
        first, second = (side.drop("help") for side in (first.drop("latest"), second))
        met = _met_in_lists(ledger, first, second).filter(F.col("uid_1") != F.col("uid_2"))
        pairs = _totals(met, with_overlap=True, **_of_classes(crowd))
        pairs = _with_degree(pairs, threshold, known, ledger)
        return pairs if crowd is not None else pairs.filter(F.col("degree") <= threshold)
    met = _pairs_once(ledger)
    if crowd is None:
        met = met.filter(
            (F.col("gap_1") / F.col("n_1") <= threshold) | (F.col("gap_2") / F.col("n_2") <= threshold)
        )

    def direction(k: int, other: int) -> Column:
        return F.struct(
            F.col(f"uid_{k}").alias("uid_1"),
            F.col(f"uid_{other}").alias("uid_2"),
            F.col(f"gap_{k}").alias("gap"),
            F.col(f"n_{k}").alias("n"),
            "overlap",
            *[F.col(f"class_{j}").alias(f"class_{i}") for i, j in ((1, k), (2, other)) if crowd is not None],
            *(["meets"] if crowd is not None else []),
        )

    both = met.select(F.inline(F.array(direction(1, 2), direction(2, 1))))
    pairs = _with_degree(both, threshold, known, ledger)
    return pairs if crowd is not None else pairs.filter(F.col("degree") <= threshold)


def _pairs_once(ledger: Ledger) -> DataFrame:
    """Every pair of users with a common ordinary item in one row, with ``gap_1`` and ``n_1`` of the first
    towards the second, ``gap_2`` and ``n_2`` the other way, ``overlap`` and what :func:`_of_classes` says."""
    return _summed_once(ledger, _met_in_lists(ledger, *(side.drop("help") for side in (ledger.first, ledger.second)), "uid"))


def _summed_once(ledger: Ledger, met: DataFrame) -> DataFrame:
    totals = {"overlap": F.sum(F.col("n_1") * F.col("n_2"))}
    for k, other in ((1, 2), (2, 1)):
        latest, n = F.col(f"latest_{other}"), F.col(f"n_{k}")
        totals[f"gap_{k}"] = F.sum(F.when(latest, n * _gap()).otherwise(0.0))
        totals[f"n_{k}"] = F.sum(F.when(latest, n).otherwise(0))
    return met.groupBy(*[c for c in PAIR if c in met.columns]).agg(
        *[value.alias(name) for name, value in (totals | _of_classes(ledger.crowd)).items()]
    )


def _cells(ledger: Ledger) -> tuple[DataFrame, list[str], str]:
    """Both sides of the pairs on each item, or on each cell of a large one, in lists, without a crowd; their
    columns, and how the names of the first side's lists end. They are stored: every round reads them."""
    first, second = (side.drop("help") for side in (ledger.first, ledger.second))
    lists, fields = _listed(ledger, second, "uid")
    keys = _cell_keys(second)
    if "slot" not in keys:
        return saved(lists.drop(*keys)), fields, "_2"
    own, _ = _listed(ledger, first, None)
    own = own.withColumnsRenamed({f"{c}_2": f"{c}_own" for c in fields})
    return saved(lists.join(own, keys).drop(*keys)), fields, "_own"


def named_pairs(ledger: Ledger, threshold: float, named: DataFrame) -> DataFrame:
    """Ordered pairs up to ``threshold`` of different users, for everybody and without a crowd: degree, overlap
    and ``named(uid, user_id ...)`` of both, as ``user_1, user_2 ...``.

    Names go to pairs that are one row for both directions: those of the first users to where their pairs
    are, so that only second users' take a shuffle of the pairs. They are as many as users, and too many to
    broadcast from some size on; as a broadcast at small sizes they would make what is shuffled grow by a jump.

    Pairs are made in rounds by the first user. All but one are stored with names, each before the next begins, so
    that what is shuffled at a time stays the same however many pairs there are.
    """
    degrees = {k: F.col(f"gap_{k}") / F.col(f"n_{k}") for k in (1, 2)}
    close = [F.when(degree <= threshold, degree).alias(f"degree_{k}") for k, degree in degrees.items()]
    facts = {"user_id": "user"} | {c: c for c in named.columns if c not in ("uid", "user_id")}
    spark, heavy = named.sparkSession, _heavy(ledger)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(ledger.tasks / ledger.rounds))
    cells, fields, end = _cells(ledger)

    def made(k: int) -> DataFrame:
        rows = cells.select("*", F.posexplode(f"uid{end}").alias("_at", "uid_1"))
        if ledger.rounds > 1:
            rows = rows.filter(dealt(["uid_1"], F.lit(ledger.rounds)) == k)
        own = {c: F.get(f"{c}{end}", F.col("_at")) for c in fields if c != "uid"}
        own["score"] = _decoded(ledger, own["score"])
        rows = rows.select("uid_1", *[value.alias(f"{c}_1") for c, value in own.items()], *[f"{c}_2" for c in fields])
        met = _dealt_met(ledger, rows, fields, "uid", tasks, heavy)
        pairs = _summed_once(ledger, met).select("uid_1", "uid_2", *close, "overlap")
        pairs = pairs.filter(F.col("degree_1").isNotNull() | F.col("degree_2").isNotNull())
        for side in (1, 2):
            names = named.select(F.col("uid").alias(f"uid_{side}"), *[F.col(c).alias(f"{name}_{side}") for c, name in facts.items()])
            pairs = pairs.join(names.hint("shuffle_hash"), f"uid_{side}").drop(f"uid_{side}")
        return pairs

    paths = [fresh_path(spark, "table") for _ in range(1, ledger.rounds)]
    for k, path in enumerate(paths, 1):
        stored(made(k), path)
    pairs = made(0)
    if paths:
        pairs = spark.read.schema(pairs.schema).parquet(*paths).unionByName(pairs)

    def direction(k: int, other: int) -> Column:
        names = [F.col(f"{name}_{j}").alias(f"{name}_{i}") for i, j in ((1, k), (2, other)) for name in facts.values()]
        return F.struct(*names, F.col(f"degree_{k}").alias("degree"), "overlap")

    both = pairs.select(F.inline(F.array(direction(1, 2), direction(2, 1))))
    return both.filter(F.col("degree").isNotNull())


def asked_sides(ledger: Ledger, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join for the users ``chosen(uid)``: their entries, and everybody's on their items."""
    first = saved(ledger.first.join(chosen, "uid", "left_semi"))
    return first, ledger.second.join(first.select("item_id").distinct(), "item_id", "left_semi")


def _with_degree(pairs: DataFrame, threshold: float, known: DataFrame | None, ledger: Ledger) -> DataFrame:
    """Replace ``gap`` and ``n`` by ``degree``, with what the classes of a pair add to it.

    Where only exact agreement counts, a pair that meets on a hot item while its classes are not
    ``known`` disagrees there: it has no degree. Where hot items share bits, the pairs that this could
    decide are looked up by the hot items themselves.
    """
    crowd = ledger.crowd
    if crowd is None:
        return pairs.withColumn("degree", F.col("gap") / F.col("n")).drop("gap", "n")
    zero = F.lit(0)
    # Pairs that do not meet have no classes to look for: numbers below 0, which no class has, part them.
    apart = -1 - F.pmod(F.xxhash64("uid_1", "uid_2"), F.lit(1 << 30))
    pairs = pairs.withColumn("class_1", F.when(F.col("meets"), F.col("class_1")).otherwise(apart))
    pairs = pairs.join(known, ["class_1", "class_2"], "left")
    apart_by_class = F.lit(False)
    if threshold <= 0:
        apart_by_class = F.col("hot_n").isNull() & F.col("meets")
        if not crowd.exact:
            doubtful = apart_by_class & (F.col("gap") == 0)
            for k, side in ((1, crowd), (2, ledger.others)):
                asked = F.when(doubtful, F.col(f"class_{k}")).otherwise(apart)
                hots = side.known.withColumnsRenamed({"class_id": f"asked_{k}", "hots": f"hots_{k}"})
                pairs = pairs.withColumn(f"asked_{k}", asked).join(hots, f"asked_{k}", "left").drop(f"asked_{k}")
            pairs = pairs.withColumn("meets", F.coalesce(F.arrays_overlap("hots_1", "hots_2"), F.col("meets"))).drop("hots_1", "hots_2")
    gap = F.col("gap") + F.coalesce("hot_gap", zero)
    n = F.col("n") + F.coalesce("hot_n", zero)
    full = {"degree": F.when(~apart_by_class, gap / n), "hot_degree": F.col("hot_gap") / F.col("hot_n")}
    if "overlap" in pairs.columns:
        full["overlap"] = F.col("overlap") + F.coalesce("hot_overlap", zero)
    return pairs.withColumns(full).drop("gap", "n", "hot_gap", "hot_n", "class_1", "class_2", "meets")


def _blocks(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members of each class in blocks, ``class_id, block`` and a list per other column (``uids`` ...),
    and the number of blocks of classes of more than one."""
    hot = saved(in_pieces(counts_of(members, ["class_id"]), MEMBER_BLOCK))
    facts = [c for c in members.columns if c != "class_id"]
    cut = _in_blocks(members, hot)
    lists = cut.groupBy("class_id", "block").agg(F.collect_list(F.struct(*facts)).alias("people"))
    return lists.select("class_id", "block", *[F.col(f"people.{c}").alias(f"{c}s") for c in facts]), hot


def _in_blocks(members: DataFrame, hot: DataFrame) -> DataFrame:
    block = dealt(["uid"], F.coalesce("pieces", F.lit(1)))
    return members.join(F.broadcast(hot), "class_id", "left").withColumn("block", block).drop("pieces")


def users_of_classes(close: DataFrame, firsts: DataFrame, members: DataFrame, but: DataFrame | None = None) -> DataFrame:
    """``uid_1, uid_2``, the other columns of both sides and those of ``close(class_1, class_2, ...)`` for every
    pair of different members that is not in ``but(uid_1, uid_2)``.

    A first user meets whole blocks of second ones, in lists, and what to leave out of a block is a list
    too: pairs are made last, and no pair is shuffled.
    """
    firsts = _named(firsts, "_1")
    one = ["class_1"]
    many = hot_keys(saved(counts_of(firsts, one)))
    pairs = split_join(firsts, close, one, many, ["uid_1"], hot_keys(saved(counts_of(close, one))), ["class_2"])
    lists, hot = _blocks(members)
    pieces = hot.withColumnRenamed("class_id", "class_2")
    each = F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1))
    pairs = pairs.join(F.broadcast(pieces), "class_2", "left").withColumn("block", each).drop("pieces")
    key = ["class_2", "block"]
    if but is not None:
        at = _in_blocks(members.select("uid", "class_id"), hot).withColumnsRenamed({"uid": "uid_2", "class_id": "class_2"})
        out = but.select("uid_1", "uid_2").join(at, "uid_2").groupBy("uid_1", *key).agg(F.collect_list("uid_2").alias("out"))
        pairs = pairs.join(out, ["uid_1", *key], "left")
    facts = [c for c in members.columns if c != "class_id"]
    pairs = pairs.join(lists.withColumnRenamed("class_id", "class_2"), key)
    pairs = pairs.select(*pairs.columns, F.posexplode("uids").alias("_at", "uid_2"))
    kept = F.col("uid_1") != F.col("uid_2")
    if but is not None:
        kept = kept & ~F.coalesce(F.array_contains("out", F.col("uid_2")), F.lit(False))
    named = {f"{c}_2": F.get(f"{c}s", F.col("_at")) for c in facts if c != "uid"}
    return pairs.filter(kept).withColumns(named).drop("_at", "block", "out", *[f"{c}s" for c in facts])


def _named(side: DataFrame, end: str) -> DataFrame:
    names = {c: f"{c}{end}" for c in side.columns}
    return side.withColumnsRenamed(names | {"class_id": f"class{end}"})


def _on_items_of(reviews: DataFrame, users: DataFrame) -> DataFrame:
    """The reviews, by anybody, of the items that ``users(user_id)`` reviewed."""
    # A stored table has a size: few users are broadcast, and no review is shuffled to find theirs.
    theirs = reviews.join(saved(users.select("user_id").distinct()), "user_id", "left_semi")
    items = saved(theirs.select("item_id").distinct())
    return reviews.join(items, "item_id", "left_semi")


def _listed_edges(
    ledger: Ledger, threshold: float, known: DataFrame | None, chosen: DataFrame | None, named: DataFrame
) -> DataFrame:
    """The edges with a crowd, or from the users ``chosen(uid)``, and ``named`` of both users."""
    listed = neighbour_pairs(ledger, threshold, known, chosen)
    shape = ["uid_1", "uid_2", "degree", "overlap"]
    if ledger.crowd is not None:
        listed = saved(listed.select(shape))
    edges = listed.filter(F.col("degree") <= threshold).select(shape)
    for k in (1, 2):
        names = {"uid": f"uid_{k}", "user_id": f"user_{k}", "help": f"help_{k}"}
        edges = edges.join(named.withColumnsRenamed(names), f"uid_{k}")
    if ledger.crowd is not None:
        members = saved(ledger.crowd.members.select("uid", "class_id").join(named, "uid"))
        firsts = members if chosen is None else members.join(chosen, "uid", "left_semi")
        close = known.withColumn("degree", F.col("hot_gap") / F.col("hot_n")).filter(F.col("degree") <= threshold)
        hot_only = users_of_classes(close, firsts, members, listed)
        hot_only = hot_only.withColumnsRenamed({"user_id_1": "user_1", "user_id_2": "user_2", "hot_overlap": "overlap"})
        edges = edges.unionByName(hot_only.select(edges.columns))
    return edges


def agreement_edges(
    reviews: DataFrame,
    threshold: float = PEER_THRESHOLD,
    with_helpfulness: bool = False,
    positive_only: bool = False,
    hot_least: int = HOT_ITEM_ENTRIES,
    users: DataFrame | None = None,
    hot_count: int | None = None,
) -> DataFrame:
    """Ordered pairs of different users whose ``degree`` is at most ``threshold``.

    ``overlap`` counts the pairs of reviews of a common item. With helpfulness, ``help_1`` and
    ``help_diff`` (second minus first) are added; ``positive_only`` keeps gains. ``users(user_id)``
    asks for pairs with these first users only, and only reviews of items that they reviewed are
    compared then; the result for everybody is pairwise and can be as large as that.
    """
    rated = with_helpfulness or positive_only
    if users is None:
        ledger = open_ledger(reviews, rated, hot_least, hot_count)
        named = ledger.users.select("uid", "user_id", *(["help"] if rated else []))
    else:
        ledger = open_ledger(_on_items_of(reviews, users), False, hot_least, hot_count)
        named = ledger.users.select("uid", "user_id")
        named = named.join(user_helpfulness(reviews), "user_id") if rated else named
    chosen = numbers_of(ledger, users)
    known = None if ledger.crowd is None else class_pairs(ledger.crowd, threshold, chosen)
    if ledger.crowd is None and chosen is None:
        edges = named_pairs(ledger, threshold, named)
    else:
        edges = _listed_edges(ledger, threshold, known, chosen, named)
    help_diff = F.col("help_2") - F.col("help_1")
    if positive_only:
        edges = edges.filter(help_diff > 0)
    columns = ["user_1", "user_2", "degree", "overlap"]
    return edges.select(*columns, *(["help_1", help_diff.alias("help_diff")] if rated else []))

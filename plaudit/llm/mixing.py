"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plaudit.llm.common import row_ident, shares
from plaudit.operators.skew import hot_keys, split_join
from plaudit.sources.shared import saved

# Weights of the sources in code-point order, repeating; copies of a source or
# document at most.
WEIGHTS = (5, 2, 1)
MOST = 3
# Hexadecimal digits of the random numbers, which a double holds exactly.
DIGITS = 12
# Documents of a source that are ranked together.
ROWS_TOGETHER = 20_000
# Largest fitting documents that come first into what the drawn ones leave of a source's target.
FILLS = 4


def words(text: Column) -> Column:
    """How many ``[^\\x20\\x09-\\x0D]+`` a text has; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key() -> Column:
    """Sources in code-point order, the null source last."""
    return F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes(source_key, source_size)`` with ``target``.

    Targets are min(``most`` * size, level * weight), with the level at which they add up to the
    whole. Sources fill up in the order of ``most`` * size / weight, so running sums over that
    order give the level: one row per source, never per document.
    """
    every = Window.partitionBy(F.lit(0))
    place = F.row_number().over(every.orderBy("source_key")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("room", F.lit(most) * F.col("source_size"))
    before = every.orderBy(F.col("room") / F.col("weight"), "source_key").rowsBetween(Window.unboundedPreceding, -1)
    s = s.select(
        "*",
        F.sum("source_size").over(every).alias("whole"),
        F.sum("weight").over(every).alias("weights"),
        F.coalesce(F.sum("room").over(before), F.lit(0)).alias("full_room"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("full_weight"),
    )
    # The level if the sources before this one are full and no other is.
    s = s.withColumn("level", (F.col("whole") - F.col("full_room")) / (F.col("weights") - F.col("full_weight")))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("room"), F.col("level"))
    s = s.withColumn("level", F.max(fits).over(every))
    room = F.col("room").cast("double")
    return s.select(
        "source_key", "source_size", F.least(room, F.coalesce(F.col("level") * F.col("weight"), room)).alias("target")
    )


def random_number(key: Column) -> Column:
    """Uniform in (0, 1), the same for the same key in every run."""
    digits = F.conv(F.substring(F.md5(key.cast("binary")), 1, DIGITS), 16, 10).cast("double")
    return (digits + 0.5) / float(16**DIGITS)


def _within(placed: DataFrame, goals: DataFrame) -> DataFrame:
    """``source_key, row_key``: documents whose running words in Pareto order stay within ``goals(source_key, left, p)``.

    ``placed(source_key, row_key, u, share, size)``: shares are summed, and only the one in which
    ``left`` is reached is ordered.
    """
    before = Window.partitionBy("source_key").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("source_key", "share").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0))).join(goals, "source_key")
    reached = sums.where("start <= left and start + words > left").select("source_key", "share", "start", "left", "p")
    whole = sums.where("start + words <= left").select("source_key", "share")
    odds = F.try_divide(F.col("u") / (1 - F.col("u")), F.try_divide(F.col("p"), 1 - F.col("p")))
    running = F.sum("size").over(Window.partitionBy("source_key", "share").orderBy("rank", "row_key"))
    edge = placed.join(reached, ["source_key", "share"]).withColumn("rank", odds).withColumn("running", running)
    edge = edge.where(F.col("start") + F.col("running") <= F.col("left"))
    in_whole = placed.join(whole, ["source_key", "share"], "left_semi")
    return in_whole.select("source_key", "row_key").unionByName(edge.select("source_key", "row_key"))


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies, source_key, ident`` for each row of ``docs(doc_id, text, source)``.

    A source that needs r times its words takes floor(r) whole copies of each document for
    certain. For the rest, p = r - floor(r), documents are ranked by random odds over inclusion
    odds, U / (1 - U) over p / (1 - p), and drawn in that order while their words fit: Pareto
    order sampling of a size fixed in words. What the first one that does not fit leaves open
    goes, ``FILLS`` times, to the largest document not drawn that fits. From then on documents
    larger than what is open are left out and the others drawn on in Pareto order, round by round
    until no document with words fits.

    Ranks need running sums of one source's words: the random numbers are cut into equal shares,
    these are summed, and only the share in which the target is reached is ordered.

    A null text has size 0 and takes 0 words. A null source is a source, the last one. Repeated
    rows are drawn apart; a random number belongs to (doc_id, text, number of the repeat). An
    empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        source_key().alias("source_key"),
        words(F.col("text")).alias("size"),
        row_ident().alias("ident"),
    )
    repeat = F.row_number().over(Window.partitionBy("source_key", "ident").orderBy("size"))
    rows = rows.withColumn("row_key", F.concat_ws(":", "ident", repeat))
    rows = saved(rows.withColumn("u", random_number(F.col("row_key"))))

    sizes = rows.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    ratio = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    plan = targets(sizes, weights, most).withColumn("certain", F.floor(ratio + F.lit(1e-12)).cast("long"))
    left = F.greatest(F.lit(0.0), F.col("target") - F.col("certain") * F.col("source_size"))
    plan = saved(plan.withColumn("left", left).withColumn("p", F.coalesce(F.try_divide("left", "source_size"), F.lit(0.0))))

    # p is the same within a source, so the rank follows U, and shares of U are runs of ranks.
    pieces = shares(rows, ROWS_TOGETHER)
    placed = rows.withColumn("share", F.floor(F.col("u") * pieces).cast("long"))
    first = _within(placed, plan.select("source_key", "left", "p")).withColumn("in_first", F.lit(True))
    drawn = saved(
        placed.join(first, ["source_key", "row_key"], "left")
        .select("doc_id", "source_key", "ident", "row_key", "size", "u", "share", F.coalesce("in_first", F.lit(False)).alias("drawn"))
    )

    taken = drawn.groupBy("source_key").agg(F.sum(F.when(F.col("drawn"), F.col("size")).otherwise(0)).alias("words"))
    # A source may hold most of the documents: what is known of sources is joined piece by piece.
    hot = saved(hot_keys(drawn.groupBy("source_key").agg(F.count("*").alias("n"))))

    def with_source(df: DataFrame, known: DataFrame) -> DataFrame:
        return split_join(df, known, ["source_key"], hot, ["row_key"])

    gaps = plan.join(taken, "source_key").select(
        "source_key", (F.col("left") - F.col("words")).alias("gap"), F.array().cast("array<string>").alias("filled")
    )
    for _ in range(FILLS):
        fitting = with_source(drawn, gaps).where(
            "not drawn and size > 0 and size <= gap and not array_contains(filled, row_key)"
        )
        best = fitting.groupBy("source_key").agg(F.max(F.struct("size", "row_key")).alias("best"))
        gaps = saved(
            gaps.join(best, "source_key", "left").select(
                "source_key",
                (F.col("gap") - F.coalesce("best.size", F.lit(0))).alias("gap"),
                F.when(F.col("best").isNull(), F.col("filled"))
                .otherwise(F.array_append("filled", F.col("best.row_key")))
                .alias("filled"),
            )
        )
    # Every round draws at least the first document that fits, so rounds end.
    goals = gaps.select("source_key", F.col("gap").alias("left")).join(plan.select("source_key", "p"), "source_key")
    rest = with_source(drawn, gaps).where("not drawn and size > 0 and not array_contains(filled, row_key)")
    rest = rest.select("source_key", "row_key", "u", "share", "size")
    late = None
    while True:
        fitting = saved(with_source(rest, goals).where("size <= left").select(rest.columns))
        if not fitting.limit(1).count():
            break
        more = saved(_within(fitting, goals))
        late = more if late is None else late.unionByName(more)
        words_in = fitting.join(more, ["source_key", "row_key"]).groupBy("source_key").agg(F.sum("size").alias("words"))
        goals = saved(
            goals.join(words_in, "source_key", "left").select(
                "source_key", (F.col("left") - F.coalesce("words", F.lit(0))).alias("left"), "p"
            )
        )
        rest = fitting.join(more, ["source_key", "row_key"], "left_anti")
    if late is not None:
        drawn = drawn.join(late.withColumn("late", F.lit(True)), ["source_key", "row_key"], "left")
        drawn = drawn.withColumn("drawn", F.col("drawn") | F.coalesce("late", F.lit(False)))
    once = (F.col("drawn") | F.array_contains("filled", F.col("row_key"))).cast("long")
    return (
        with_source(with_source(drawn, plan.drop("left", "p")), gaps)
        .withColumn("copies", F.col("certain") + once)
        .select(
            "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source_key", "ident"
        )
    )

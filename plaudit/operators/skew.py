"""Equi-joins whose hot keys are dealt over several tasks.

Spark splits a skewed partition of a sort-merge join by itself only where nothing else stands on the
same key: not where a side is an aggregate on it, nor before an aggregate on it. Here the keys are
split beforehand. A key is hot if it holds more than an even share of a side's rows, so there can be
no more hot keys than shares; only these few rows are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Shares of a side for every shuffle partition; a key with more rows than a share is cut.
SHARES = 4
# Rows below which no key is worth cutting.
LEAST_ROWS = 4096


def hot_keys(counts: DataFrame, least: int | None = None) -> DataFrame:
    """The hot keys of ``counts(key ..., n)``, and the ``pieces`` each is cut into.

    With P shuffle partitions a share is a 4 P-th of all rows, ``least`` (4,096) at least: at most 4 P
    keys can hold more.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    partitions = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(least or LEAST_ROWS, -(-total // (SHARES * partitions)))
    return counts.where(F.col("n") > share).withColumn("pieces", F.ceil(F.col("n") / share).cast("int")).drop("n")


def in_pieces(counts: DataFrame, size: int) -> DataFrame:
    """The keys of ``counts(key ..., n)`` with more than ``size`` rows, and the ``pieces`` of that size each is cut into.

    Unlike shares these do not grow with the data: for lists that are one row each, and are written out again and
    again one after the other, which compresses only while a list is short.
    """
    return counts.where(F.col("n") > size).withColumn("pieces", F.ceil(F.col("n") / size).cast("int")).drop("n")


def split_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_hot: DataFrame,
    left_by: list[str],
    right_hot: DataFrame | None = None,
    right_by: list[str] | None = None,
) -> DataFrame:
    """Inner join on ``keys``. A hot key's rows are dealt over pieces by ``by``, and the other side's
    rows of that key stand in every piece; with both sides hot, in a grid of pieces.

    ``hot`` comes from :func:`hot_keys` on the counts of the side. Without ``right_hot`` the
    right side has few rows per key, one as a rule.
    """
    hot = left_hot.withColumnRenamed("pieces", "_lefts")
    if right_hot is not None:
        hot = hot.join(right_hot.withColumnRenamed("pieces", "_rights"), keys, "full")
    else:
        hot = hot.withColumn("_rights", F.lit(1))

    def cut(side: DataFrame, own: str, own_at: str, by: list[str], other: str, other_at: str) -> DataFrame:
        pieces, others = (F.coalesce(F.col(c), F.lit(1)) for c in (own, other))
        marked = side.join(F.broadcast(hot), keys, "left").withColumn(own_at, dealt(by, pieces))
        if other == "_rights" and right_hot is None:
            return marked.withColumn(other_at, F.lit(0)).drop("_lefts", "_rights")
        return marked.withColumn(other_at, F.explode(F.sequence(F.lit(0), others - 1))).drop("_lefts", "_rights")

    one = cut(left, "_lefts", "_i", left_by, "_rights", "_j")
    two = cut(right, "_rights", "_j", right_by or keys, "_lefts", "_i")
    return one.join(two, [*keys, "_i", "_j"]).drop("_i", "_j")


def dealt(by: list[str], pieces: Column) -> Column:
    """A piece from 0, by the row alone, so that a task run again deals it alike."""
    return F.pmod(F.xxhash64(*by), pieces).cast("int")


def counts_of(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


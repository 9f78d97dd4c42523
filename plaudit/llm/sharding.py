"""Shards of near-equal bytes: a minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

import bisect
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, functions as F

from plaudit.llm.common import numbered
from plaudit.sources.shared import saved

# Hexadecimal digits of a group's key that a refinement looks further each time.
DIGITS = 3
# Digits of a text's fingerprint.
WHOLE = 32


@dataclass(frozen=True)
class Run:
    """Consecutive groups: all keys that start with ``prefix``."""

    prefix: str
    size: int
    groups: int
    largest: int

    @property
    def atomic(self) -> bool:
        return self.groups == 1


def greedy_ends(runs: list[Run], cumulative: list[int], capacity: int, shards: int, whole_only: bool) -> tuple[bool, list[int]]:
    """Fill shard after shard up to ``capacity``; whether all fits, and the runs where shards end.

    With ``whole_only`` a run of several groups is never cut, which can only ask for more
    capacity than needed; else it is cut anywhere, which can only ask for less.
    """
    ends, filled, total = [], 0, cumulative[-1]
    for _ in range(shards):
        if filled >= total:
            return True, ends
        at = bisect.bisect_right(cumulative, filled + capacity) - 1
        here = cumulative[at]
        if not whole_only and at < len(runs) and not runs[at].atomic:
            here = max(here, min(filled + capacity, cumulative[at + 1]))
        ends.append(at)
        if here <= filled:
            return False, ends
        filled = here
    return filled >= total, ends


def smallest_capacity(runs: list[Run], shards: int, whole_only: bool) -> int:
    """The least capacity with which the greedy filling needs no more than ``shards`` shards."""
    cumulative = [0, *accumulate(r.size for r in runs)]
    low = max(max(r.largest for r in runs), -(-cumulative[-1] // shards))
    high = max(cumulative[-1], low)
    while low < high:
        middle = (low + high) // 2
        if greedy_ends(runs, cumulative, middle, shards, whole_only)[0]:
            high = middle
        else:
            low = middle + 1
    return low


def _runs(groups: DataFrame, digits: int) -> list[Run]:
    rows = (
        groups.groupBy(F.substring("key", 1, digits).alias("prefix"))
        .agg(F.sum("size").alias("size"), F.count("*").alias("groups"), F.max("size").alias("largest"))
        .collect()
    )
    return sorted((Run(r.prefix, int(r.size), r.groups, int(r.largest)) for r in rows), key=lambda r: r.prefix)


def cuts(groups: DataFrame, shards: int) -> list[str]:
    """Keys before which a new shard starts, in order, for ``groups(key, size)`` in key order.

    The driver holds runs of groups (all keys with one prefix), never the groups. Cutting runs
    nowhere, or anywhere, bounds the least capacity from both sides; the runs in which a shard
    can end between these bounds are asked for again by longer prefixes, until the bounds meet
    or each of those runs is one group. What one refinement asks for is at most
    2 * ``shards`` runs with 16 ** ``DIGITS`` parts each.
    """
    runs = _runs(groups, DIGITS)
    while runs:
        cumulative = [0, *accumulate(r.size for r in runs)]
        upper = smallest_capacity(runs, shards, whole_only=True)
        lower = smallest_capacity(runs, shards, whole_only=False)
        ends_high = greedy_ends(runs, cumulative, upper, shards, whole_only=True)[1]
        ends_low = greedy_ends(runs, cumulative, lower, shards, whole_only=False)[1]
        doubtful = {i for i in (*ends_high, *ends_low) if i < len(runs) and not runs[i].atomic}
        if upper == lower or not doubtful:
            return [runs[i].prefix for i in ends_high if i < len(runs)][: shards - 1]
        wanted = {runs[i].prefix for i in doubtful}
        parts = []
        for depth in {len(prefix) for prefix in wanted}:
            own = [prefix for prefix in wanted if len(prefix) == depth]
            parts += _runs(groups.where(F.substring("key", 1, depth).isin(own)), depth + DIGITS)
        runs = sorted([r for r in runs if r.prefix not in wanted] + parts, key=lambda r: r.prefix)
    return []


def shard_by_bytes(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for each row of ``docs(doc_id, text)``.

    Law ``bytes``: equal texts are one atomic group, groups lie in the order of their texts'
    fingerprints, and the shards are the contiguous partition whose largest shard is smallest:
    binary search for the least capacity, checked greedily, then cut there. Groups that are
    larger than a fair share of what is left get a shard of their own first, or the greedy
    filling would leave later shards empty. Slots count each shard's rows from 0 in the order
    of a hash of the row, numbered in shares that no group of copies can fill alone.

    A null text has no bytes (size 1, checksum 0) and is its own group, apart from the empty
    text. Repeated rows each get a slot. An empty table gives no rows; with fewer groups than
    shards some shards stay empty. Other columns are ignored.
    """
    text = F.col("text")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    # The leading digit is always 0 or 1, so that the null text is a key of its own.
    key = F.coalesce(F.concat(F.lit("0"), F.md5(text.cast("binary"))), F.rpad(F.lit("1"), WHOLE + 1, "0"))
    rows = saved(
        docs.select(
            F.col("doc_id").cast("long"),
            size.alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0).cast("long")).alias("text_crc32"),
            key.alias("key"),
        )
    )
    groups = saved(rows.groupBy("key").agg(F.sum("size").alias("size")))
    alone = _giants(groups, shards)
    rest = groups.where(~F.col("key").isin(list(alone))) if alone else groups
    starts = cuts(rest, shards - len(alone))
    shard = F.lit(len(alone))
    for start in starts:
        shard = shard + (F.col("key") >= start).cast("int")
    for number, giant in enumerate(alone):
        shard = F.when(F.col("key") == giant, F.lit(number)).otherwise(shard)
    placed = numbered(rows.withColumn("shard", shard.cast("int")), ["shard"], ["doc_id", "key"], "slot")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _giants(groups: DataFrame, shards: int) -> list[str]:
    """Keys of groups above the fair share of what smaller groups leave; fewer than ``shards``."""
    total = groups.agg(F.sum("size")).first()[0] or 0
    # Only the largest groups can be above total / shards, and no more than ``shards`` of them.
    large = groups.orderBy(F.desc("size"), "key").limit(shards).collect()
    alone, left = [], int(total)
    for row in large[: shards - 1]:
        if row["size"] * (shards - len(alone)) <= left:
            break
        alone.append(row["key"])
        left -= int(row["size"])
    return alone

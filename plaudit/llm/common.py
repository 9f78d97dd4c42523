"""What the operators of this subpackage share: tables, connected components, grouped batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plaudit.operators.skew import LEAST_ROWS, hot_keys, split_join
from plaudit.sources.shared import fresh_path, saved, scratch, stored


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def row_ident() -> Column:
    """Same for the same doc_id and text, and for nothing else."""
    return F.concat_ws(
        ":",
        F.coalesce(F.col("doc_id").cast("string"), F.lit("-")),
        F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("-")),
    )


def shares(df: DataFrame, rows: int) -> int:
    """How many shares of about ``rows`` rows ``df`` has; at least one."""
    return max(1, -(-df.count() // rows))


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """``(node, label)`` for every node of ``edges(a, b)``: the label is the smallest node reachable.

    The tables of rounds have ``files`` files at most, where the caller knows how few rows there are.

    Alternating large-star and small-star: in the first every node hands its larger neighbours
    its smallest one, in the second its smaller neighbours. A star's centre is the group minimum
    that a map-side aggregate finds, joined back to the edges, so that no neighbour list is ever
    gathered, and the edges of a node with a third of all are dealt over many tasks. Every
    round is a stored table, so a lost executor costs one round at most; they go when the result is
    stored. Rounds end when the edges are stars, which no round changes. Null ends, loops and
    repeated edges change nothing; no edges, no rows.
    """
    path = fresh_path(edges.sparkSession, "table")

    def kept(df: DataFrame) -> DataFrame:
        return saved(df.coalesce(files) if files else df)

    with scratch(edges.sparkSession):
        state = kept(
            edges.where("a is not null and b is not null and a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .distinct()
        )
        rows, stars = _state_of(state)
        while not stars:
            state = kept(_small_star(_large_star(state, rows), rows))
            rows, stars = _state_of(state)
        ends = state.select(F.col("a").alias("node"), F.col("b").alias("label"))
        return stored(ends.unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()), path)


def _state_of(edges: DataFrame) -> tuple[int, bool]:
    """The number of ``edges(a, b)``, which are distinct, and whether they are stars: each larger end
    has one edge and is nobody's smaller end."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"))
    )
    nodes = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count("*").alias("n"))
    row = nodes.agg(F.coalesce(F.sum("ups"), F.lit(0)), F.max((F.col("ups") > 0) & (F.col("n") > 1))).first()
    return row[0], not row[1]


def _with_least(edges: DataFrame, least: DataFrame, key: str, by: str, rows: int) -> DataFrame:
    """``edges``, at most ``rows``, with what ``least(key, m, n)`` knows of their node ``key``."""
    if rows <= LEAST_ROWS:
        # No node can have more edges than there are, and so few are never dealt.
        return edges.join(least.drop("n"), key)
    return split_join(edges, least.drop("n"), [key], hot_keys(least.select(key, "n")), [by])


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
    least = saved(least) if 2 * rows > LEAST_ROWS else least
    larger = _with_least(both.where("v > u"), least, "u", "v", 2 * rows)
    return larger.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    least = saved(least) if rows > LEAST_ROWS else least
    lower = _with_least(edges, least, "a", "b", rows).where("b <> m")
    lower = lower.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return lower.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def in_groups(
    df: DataFrame, key: str, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``work`` on the rows of each value of ``key`` (a long or string without nulls), streamed.

    Rows are dealt by the key and sorted, and cut where it changes, which costs far less than
    one call per group when most groups are small. The caller keeps groups bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
            start = 0
            for i, now in enumerate(keys):
                if now != last:
                    if i > start:
                        kept.append(batch.slice(start, i - start))
                    if kept:
                        yield from work(pa.Table.from_batches(kept))
                    kept, start, last = [], i, now
            kept.append(batch.slice(start))
        if kept:
            yield from work(pa.Table.from_batches(kept))

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, rows: int = 20_000) -> DataFrame:
    """``df`` with each row's number, from 0, among the rows of its ``keys``, in one order.

    Rows are counted in shares of about ``rows`` rows by the hash of ``order``, and numbered
    within each, so that a key with most of the rows is numbered by many tasks. The order is by
    share, then by ``order``: the same in every run, and any rows that tie are alike in it.
    """
    placed = df.withColumn("_share", F.pmod(F.xxhash64(*order), F.lit(shares(df, rows))))
    before = Window.partitionBy(*keys).orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(*keys, "_share").agg(F.count("*").alias("_n"))
    starts = starts.select(*keys, "_share", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(*keys, "_share").orderBy(*order)) - 1
    joined = placed.withColumn("_own", own).join(starts, [*keys, "_share"])
    return joined.withColumn(name, (F.col("_start") + F.col("_own")).cast("long")).select(*df.columns, name)

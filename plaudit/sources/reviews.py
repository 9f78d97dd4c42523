"""Reviews from blank-line-separated text records, or from a columnar review table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plaudit.functions.scalars import int_div, is_blank, strip_control, utf16_length
from plaudit.schema import REVIEW_SCHEMA, STANZA_DEFAULTS


def read_stanzas(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per record; ``path`` may be any file, directory or glob Spark can read.

    Files are split by size, and a record that crosses a split is read once.
    """
    return spark.read.option("lineSep", "\n\n").text(path).select("value")


def parse_stanzas(stanzas: DataFrame, keep_blank: bool = False) -> DataFrame:
    """One nullable text column per known field.

    A line reads ``prefix/key: value``. The value loses its colons, and white space around
    each colon-separated part. The last line with a key wins, other lines are ignored.
    A record of white space alone is dropped unless ``keep_blank``.
    """
    rows = stanzas if keep_blank else stanzas.filter(~is_blank(F.col("value")))

    def last(name: str) -> Column:
        def has_key(line: Column) -> Column:
            head = F.substring_index(line, ":", 1)
            return F.contains(line, F.lit(f"/{name}")) & (F.get(F.split(head, "/", 3), F.lit(1)) == name)

        return F.try_element_at(F.filter(F.split("value", "\n"), has_key), F.lit(-1)).alias(name)

    def value(name: str) -> Column:
        at = F.instr(name, ":")
        rest = F.when(at > 0, F.substring(F.col(name), at + 1, F.length(name))).otherwise("")
        parts = F.array_join(F.transform(F.split(rest, ":"), strip_control), "")
        text = F.when(F.contains(rest, F.lit(":")), parts).otherwise(strip_control(rest))
        return F.when(F.col(name).isNotNull(), text).alias(name)

    # Values are taken apart field by field, so a field nobody asks for costs nothing.
    return rows.select(*map(last, STANZA_DEFAULTS)).select(*map(value, STANZA_DEFAULTS))


def to_reviews(fields: DataFrame, mode: str = "strict") -> DataFrame:
    """Typed reviews with derived vote columns and body length.

    ``strict`` fails the job on a malformed number, as ANSI casts do; ``permissive`` turns
    the bad part into null, and a review with an unreadable vote count has no percentage.
    """
    if mode not in ("strict", "permissive"):
        raise ValueError(f"unknown mode: {mode}")
    strict = mode == "strict"

    def typed(value: Column, kind: str) -> Column:
        return value.cast(kind) if strict else value.try_cast(kind)

    def part(index: int) -> Column:
        parts = F.split("helpfulness", "/")
        return F.element_at(parts, index) if strict else F.try_element_at(parts, F.lit(index))

    filled = fields.select(
        *[F.coalesce(name, F.lit(default)).alias(name) for name, default in STANZA_DEFAULTS.items()]
    )
    up, total = F.col("up_votes"), F.col("total_votes")
    typed_rows = filled.select(
        F.col("productId").alias("item_id"),
        F.col("userId").alias("user_id"),
        F.col("profileName").alias("profile_name"),
        "helpfulness",
        typed(F.col("score"), "double").alias("score"),
        typed(F.col("time"), "bigint").alias("review_time"),
        "summary",
        F.col("text").alias("body"),
        typed(part(1), "bigint").alias("up_votes"),
        typed(part(2), "bigint").alias("total_votes"),
    )
    return typed_rows.select(
        *[F.col(name) for name in typed_rows.columns],
        (total - up).alias("down_votes"),
        helpful_pct(up, total).alias("helpful_pct"),
        utf16_length(F.col("body")).alias("body_length"),
    )


def helpful_pct(up: Column, total: Column) -> Column:
    """Whole percentage of helpful votes, truncated; null without votes; not clamped."""
    return F.when(total != 0, int_div(up * 100, total))


def load_reviews(
    spark: SparkSession,
    path: str | list[str],
    source: str = "stanza",
    mode: str = "strict",
    keep_blank: bool = False,
    columns: list[str] | None = None,
) -> DataFrame:
    """Reviews from text records (``stanza``) or from a table saved earlier (``parquet``).

    Parsing text once and saving the result as Parquet lets later analyses read only the
    few narrow columns they need. A stored table must have the ``columns`` asked for (default:
    all of a review), with their types; else this is an error, not a column of nulls.
    """
    if source == "stanza":
        return to_reviews(parse_stanzas(read_stanzas(spark, path), keep_blank), mode)
    if source == "parquet":
        paths = [path] if isinstance(path, str) else path
        wanted = REVIEW_SCHEMA.names if columns is None else columns
        stored = spark.read.parquet(*paths)
        kinds, found = {f.name: f.dataType for f in REVIEW_SCHEMA}, {f.name: f.dataType for f in stored.schema}
        wrong = [name for name in wanted if found.get(name) != kinds[name]]
        if wrong:
            raise ValueError(f"stored reviews without, or with another type of: {', '.join(wrong)}")
        return stored.select(*wanted)
    raise ValueError(f"unknown source: {source}")

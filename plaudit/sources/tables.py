"""Review views over the sales tables that serve as test and benchmark data.

Every line item is one review, read in one of three ways: customers reviewing parts (many
reviews per user); orders reviewing a part as sold in one supplier nation (few per user,
some users with a single one); orders reviewing parts with all returned lines on one item
(a third of all reviews). Documents and pages also serve as text records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plaudit.functions.scalars import utf16_length
from plaudit.sources.reviews import helpful_pct


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _review(item: Column, user: Column) -> list[Column]:
    total = (F.col("l_orderkey") + F.col("l_linenumber")) % 11
    up = F.least(total, F.round(F.col("l_discount") * 100).cast("bigint"))
    since = F.expr("unix_timestamp(l_shipdate)")
    return [
        item.alias("item_id"),
        user.alias("user_id"),
        (1 + (F.col("l_quantity").cast("bigint") - 1) % 5).cast("double").alias("score"),
        (since + (F.col("l_partkey") % 12) * 31536000).alias("review_time"),
        up.alias("up_votes"),
        total.alias("total_votes"),
        (total - up).alias("down_votes"),
        helpful_pct(up, total).alias("helpful_pct"),
        F.concat_ws("/", up.cast("string"), total.cast("string")).alias("helpfulness"),
    ]


def customer_reviews(
    spark: SparkSession, folder: str, length: bool = False
) -> DataFrame:
    """Customers reviewing parts. ``length`` adds the size of a text.

    The size is taken from the documents before they are joined, so no text is shuffled
    for an analysis that needs only the size.
    """
    orders = _table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    lines = _table(spark, folder, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    columns = _review(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")),
        F.concat(F.lit("U"), F.col("o_custkey").cast("string")),
    )
    if not length:
        return lines.select(columns)
    documents = _table(spark, folder, "documents")
    total = documents.count()
    texts = documents.select("doc_id", utf16_length(F.col("text")).alias("body_length"))
    number = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % total
    return lines.join(texts, number == F.col("doc_id"), "left").select(
        *columns, F.lit("").alias("summary"), "body_length"
    )


def order_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Orders reviewing a part as sold by the suppliers of one nation."""
    suppliers = _table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    lines = _table(spark, folder, "lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    item = [F.lit("P"), F.col("l_partkey").cast("string"), F.lit("N"), F.col("s_nationkey").cast("string")]
    return lines.select(_review(F.concat(*item), _order()))


def returns_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Orders reviewing parts, with every returned line a review of the item ``RETURN``."""
    part = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    item = F.when(F.col("l_returnflag") == "R", "RETURN").otherwise(part)
    return _table(spark, folder, "lineitem").select(_review(item, _order()))


def _order() -> Column:
    return F.concat(F.lit("O"), F.col("l_orderkey").cast("string"))


def review_stanzas(reviews: DataFrame) -> DataFrame:
    """One text record per review of a view, without texts."""
    return reviews.select(
        F.concat_ws(
            "\n",
            _field("product/productId", F.col("item_id")),
            _field("review/userId", F.col("user_id")),
            _field("review/helpfulness", F.col("helpfulness")),
            _field("review/score", F.col("score").cast("string")),
            _field("review/time", F.col("review_time").cast("string")),
        ).alias("value")
    )


def damaged_stanzas(reviews: DataFrame) -> DataFrame:
    """The records of a view with fields that are no numbers, by the day of the review: scores on every
    fifth, times on every seventh, helpful votes on every third and all votes on every eleventh."""
    day = F.floor(F.col("review_time") / 86400)

    def or_else(days: int, text: Column, value: Column) -> Column:
        return F.when(day % days == 0, text).otherwise(value)

    votes = or_else(3, F.concat(F.lit("many/"), F.col("total_votes").cast("string")), F.col("helpfulness"))
    return reviews.select(
        F.concat_ws(
            "\n",
            _field("product/productId", F.col("item_id")),
            _field("review/userId", F.col("user_id")),
            _field("review/helpfulness", or_else(11, F.col("up_votes").cast("string"), votes)),
            _field("review/score", or_else(5, F.lit("good"), F.col("score").cast("string"))),
            _field("review/time", or_else(7, F.lit("last spring"), F.col("review_time").cast("string"))),
        ).alias("value")
    )


def document_stanzas(spark: SparkSession, folder: str) -> DataFrame:
    """One text record per document."""
    number = F.col("doc_id")
    return _stanzas(
        _table(spark, folder, "documents"), F.col("source"), number, F.col("lang"), F.col("text")
    )


def page_stanzas(spark: SparkSession, folder: str) -> DataFrame:
    """One text record per web page, colons and markup included."""
    return _stanzas(
        _table(spark, folder, "pages"), F.lit("web"), F.col("page_id"), F.col("url"), F.col("html")
    )


def _field(key: str, value: Column) -> Column:
    return F.concat(F.lit(f"{key}: "), value)


def _stanzas(df: DataFrame, item: Column, number: Column, title: Column, text: Column) -> DataFrame:
    """Line breaks in the texts become spaces, since one line holds one field."""
    return df.select(
        F.concat_ws(
            "\n",
            _field("product/productId", item),
            _field("review/userId", F.concat(F.lit("U"), number.cast("string"))),
            _field("review/helpfulness", F.concat_ws("/", (number % 7).cast("string"), (number % 11).cast("string"))),
            _field("review/score", (number % 5 + 1).cast("double").cast("string")),
            _field("review/time", (1000000000 + number * 86400).cast("string")),
            _field("review/summary", F.concat(F.lit("About: "), title)),
            _field("review/text", F.replace(text, F.lit("\n"), F.lit(" "))),
        ).alias("value")
    )

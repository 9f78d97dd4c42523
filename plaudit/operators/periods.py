"""Mean score of an item by calendar year and by fixed period."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plaudit.functions.scalars import half_up_2dp, year_text
from plaudit.schema import FIRST_PERIOD_LAST, PERIOD_LABELS, SECOND_PERIOD_LAST


def _only(reviews: DataFrame, item: str | None) -> DataFrame:
    return reviews if item is None else reviews.filter(F.col("item_id") == item)


def item_year_score(reviews: DataFrame, item: str | None = None) -> DataFrame:
    """Mean score per (item, year), two decimals; the year is text."""
    return (
        _only(reviews, item)
        .groupBy("item_id", year_text(F.col("review_time")).alias("year"))
        .agg(half_up_2dp(F.avg("score")).alias("mean_score"))
    )


def item_period_score(
    reviews: DataFrame,
    item: str | None = None,
    first_last: int = FIRST_PERIOD_LAST,
    second_last: int = SECOND_PERIOD_LAST,
) -> DataFrame:
    """Mean score per (item, period), two decimals.

    The first period ends with ``first_last`` itself, the second with ``second_last``;
    the outer two are open, so every review with a time falls in exactly one. Reviews without
    a time are a period of their own, null.
    """
    time = F.col("review_time")
    period = (
        F.when(time <= first_last, PERIOD_LABELS[0])
        .when(time > second_last, PERIOD_LABELS[2])
        .when(time > first_last, PERIOD_LABELS[1])
    )
    return (
        _only(reviews, item)
        .groupBy("item_id", period.alias("period"))
        .agg(half_up_2dp(F.avg("score")).alias("mean_score"))
    )

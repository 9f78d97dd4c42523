"""Short display form of a review."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plaudit.schema import PREVIEW_CHARS


def review_preview(reviews: DataFrame, chars: int = PREVIEW_CHARS) -> DataFrame:
    """The review's headline fields and the first ``chars`` characters of its body."""
    return reviews.select(
        "item_id",
        "user_id",
        "score",
        "helpfulness",
        "summary",
        F.concat(F.substring("body", 1, chars), F.lit("...")).alias("preview"),
    )

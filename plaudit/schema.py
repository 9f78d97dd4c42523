"""The typed review row and the constants that fix what each analysis means."""

from __future__ import annotations

from pyspark.sql import types as T

REVIEW_SCHEMA = T.StructType(
    [
        T.StructField("item_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("profile_name", T.StringType()),
        T.StructField("helpfulness", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("review_time", T.LongType()),
        T.StructField("summary", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("up_votes", T.LongType()),
        T.StructField("total_votes", T.LongType()),
        T.StructField("down_votes", T.LongType()),
        T.StructField("helpful_pct", T.LongType()),
        T.StructField("body_length", T.LongType()),
    ]
)

# The field keys of a text record and the default of each one.
STANZA_DEFAULTS = {
    "productId": "",
    "userId": "",
    "profileName": "",
    "helpfulness": "0/0",
    "score": "0.0",
    "time": "0",
    "summary": "",
    "text": "",
}

# Length classes are 1024 UTF-16 units wide.
LENGTH_STEP = 1024

# 2003-01-01 and 2008-01-01 UTC in epoch seconds, and the period labels.
FIRST_PERIOD_LAST = 1041379200
SECOND_PERIOD_LAST = 1199145600
PERIOD_LABELS = ("1997-2002", "2003-2007", "2008-2012")

# Largest mean score difference that still counts as agreement.
PEER_THRESHOLD = 0.9
SUGGEST_THRESHOLD = 0.0

# Fixed value: characters shown of a review body.
PREVIEW_CHARS = 128

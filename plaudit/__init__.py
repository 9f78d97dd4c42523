"""Product-review analytics as plain DataFrame-to-DataFrame functions on PySpark."""

from plaudit.operators.agreement import agreement_edges, user_items
from plaudit.operators.averages import (
    helpfulness_by_score,
    item_score,
    length_helpfulness,
    user_helpfulness,
    user_score,
)
from plaudit.operators.consensus import consensus_lift, consensus_rank
from plaudit.operators.peers import peer_rank
from plaudit.operators.periods import item_period_score, item_year_score
from plaudit.operators.preview import review_preview
from plaudit.operators.suggestions import suggest
from plaudit.plans.job import ANALYSES, run_job
from plaudit.sources.reviews import load_reviews, parse_stanzas, read_stanzas, to_reviews
from plaudit.sources.sinks import write_none, write_parts, write_quoted_csv

__all__ = [
    "ANALYSES",
    "agreement_edges",
    "consensus_lift",
    "consensus_rank",
    "helpfulness_by_score",
    "item_period_score",
    "item_score",
    "item_year_score",
    "length_helpfulness",
    "load_reviews",
    "parse_stanzas",
    "peer_rank",
    "read_stanzas",
    "review_preview",
    "run_job",
    "suggest",
    "to_reviews",
    "user_helpfulness",
    "user_items",
    "user_score",
    "write_none",
    "write_parts",
    "write_quoted_csv",
]

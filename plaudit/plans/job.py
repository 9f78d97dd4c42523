"""Run one named analysis as a Spark job and send the result to a sink.

    spark-submit plaudit/plans/job.py PATH ANALYSIS [SAVE] [ITEM] [--out OUT] [--source stanza|parquet]
"""

from __future__ import annotations

import argparse
import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from plaudit.operators.averages import item_score, length_helpfulness, user_helpfulness, user_score
from plaudit.operators.consensus import consensus_rank
from plaudit.operators.peers import peer_rank
from plaudit.operators.periods import item_period_score, item_year_score
from plaudit.operators.suggestions import suggest
from plaudit.sources.reviews import load_reviews
from plaudit.sources.shared import drop_saved, saved, scratch
from plaudit.sources.sinks import write_none, write_parts, write_quoted_csv

log = logging.getLogger(__name__)

Analysis = Callable[[DataFrame, "str | None"], DataFrame]

# The names by which the analyses are asked for on the command line.
ANALYSES: dict[str, Analysis] = {
    "pagerank_averageI": lambda reviews, item: consensus_rank(reviews),
    "pagerank_average": lambda reviews, item: consensus_rank(reviews),
    "pagerank_naive": lambda reviews, item: peer_rank(reviews, "divergence"),
    "pagerank_medium": lambda reviews, item: peer_rank(reviews, "divergence"),
    "pagerank_optimized": lambda reviews, item: peer_rank(reviews, "agreement"),
    "usersuggestion_naive": lambda reviews, item: suggest(reviews, "all"),
    "usersuggestion_improved": lambda reviews, item: suggest(reviews, "multi"),
    "usersuggestion_optimized": lambda reviews, item: suggest(reviews, "overlap"),
    "filmdatescore": item_year_score,
    "filmdatescore_aggregated": item_period_score,
    "filmscore": lambda reviews, item: item_score(reviews),
    "lengthhelpfulness": lambda reviews, item: length_helpfulness(reviews),
    "userscore": lambda reviews, item: user_score(reviews),
    "userhelpfulness": lambda reviews, item: user_helpfulness(reviews),
}

SAVED = ("local", "distributed", "s3")

# What each analysis reads besides item_id and user_id; a stored table has to have it.
_PEER = ("score", "review_time", "helpful_pct")
COLUMNS: dict[str, tuple[str, ...]] = {
    "pagerank_averageI": ("score", "helpful_pct"),
    "pagerank_average": ("score", "helpful_pct"),
    "pagerank_naive": _PEER,
    "pagerank_medium": _PEER,
    "pagerank_optimized": _PEER,
    "usersuggestion_naive": ("score", "review_time"),
    "usersuggestion_improved": ("score", "review_time"),
    "usersuggestion_optimized": ("score", "review_time"),
    "filmdatescore": ("score", "review_time"),
    "filmdatescore_aggregated": ("score", "review_time"),
    "filmscore": ("score",),
    "lengthhelpfulness": ("helpful_pct", "body_length"),
    "userscore": ("score",),
    "userhelpfulness": ("helpful_pct",),
}

# These read the reviews several times: text is parsed once for them, and its narrow
# columns are kept as a table. The pair analyses keep a smaller table of their own.
SEVERAL_PASSES = ("pagerank_averageI", "pagerank_average")


def run_job(
    spark: SparkSession,
    path: str | list[str],
    analysis: str,
    save: str = "local",
    item: str | None = None,
    out: str | None = None,
    source: str = "stanza",
    mode: str = "strict",
    keep_blank: bool = False,
) -> int:
    """Load reviews, run ``analysis``, save the result and return its row count.

    ``save`` is ``local`` (quoted CSV), ``distributed`` or ``s3`` (plain CSV), each with one file
    per partition at ``out``; anything else computes and saves nothing. The result is computed
    once, its rows are counted as they are written, and tables kept meanwhile are deleted.
    """
    if analysis not in ANALYSES:
        raise ValueError(f"unknown analysis: {analysis}; known: {', '.join(ANALYSES)}")
    if save in SAVED and out is None:
        raise ValueError(f"save={save} needs an output path")
    start = time.monotonic()
    with scratch(spark):
        columns = ["item_id", "user_id", *COLUMNS[analysis]]
        reviews = load_reviews(spark, path, source, mode, keep_blank, columns)
        if source == "stanza" and analysis in SEVERAL_PASSES:
            reviews = saved(reviews.select("item_id", "user_id", "score", "helpful_pct"))
        counted = Observation()
        result = ANALYSES[analysis](reviews, item).observe(counted, F.count(F.lit(1)).alias("rows"))
        if save == "local":
            write_quoted_csv(result, out)
        elif save in SAVED:
            write_parts(result, out)
        else:
            write_none(result)
        rows = counted.get["rows"]
    log.info("%s: %d rows in %d ms", analysis, rows, (time.monotonic() - start) * 1000)
    return rows


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="plaudit")
    parser.add_argument("path")
    parser.add_argument("analysis", choices=list(ANALYSES))
    parser.add_argument("save", nargs="?", default="local")
    parser.add_argument("item", nargs="?")
    parser.add_argument("--out", help="output path; a folder or object-store URI")
    parser.add_argument("--source", default="stanza", choices=["stanza", "parquet"])
    parser.add_argument("--mode", default="strict", choices=["strict", "permissive"])
    parser.add_argument("--keep-blank", action="store_true")
    args = parser.parse_args(argv)
    if args.save in SAVED and not args.out:
        # A default would lie on each executor's own disk.
        parser.error(f"{args.save} needs --out")
    logging.basicConfig(level=logging.INFO)
    spark = (
        SparkSession.builder.appName("plaudit")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .getOrCreate()
    )
    try:
        run_job(
            spark,
            args.path,
            args.analysis,
            args.save,
            args.item,
            args.out,
            args.source,
            args.mode,
            args.keep_blank,
        )
    finally:
        drop_saved(spark)
        spark.stop()


if __name__ == "__main__":
    main()

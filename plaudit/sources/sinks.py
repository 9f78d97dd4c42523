"""Where a result goes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

def _as_text(df: DataFrame) -> DataFrame:
    return df.select([F.col(name).cast("string").alias(name) for name in df.columns])


def write_quoted_csv(df: DataFrame, path: str) -> None:
    """Quoted CSV without a header: one file per partition, files and rows in the result's order."""
    _as_text(df).write.mode("overwrite").option("quoteAll", True).csv(path)


def write_parts(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """One file per partition at any path or object-store URI, replacing what is there."""
    if fmt == "csv":
        df = _as_text(df)
    elif fmt != "parquet":
        raise ValueError(f"unknown format: {fmt}")
    df.write.mode("overwrite").format(fmt).save(path)


def write_none(df: DataFrame) -> None:
    """Compute every row and keep none."""
    df.write.format("noop").mode("overwrite").save()

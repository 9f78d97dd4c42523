"""Cleaning of embedding tables, for the operators on vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def doubles(embeddings: DataFrame, *columns: str) -> DataFrame:
    """The given columns and ``vector`` in double precision, usable vectors only."""
    vector = F.col("embedding").cast("array<double>")
    return embeddings.select(*columns, vector.alias("vector")).where(usable(F.col("vector")))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column without nulls, all lists of one length, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by the largest component first, so that no square overflows."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))

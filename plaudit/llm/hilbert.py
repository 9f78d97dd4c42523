"""Nearest vectors by windows on several shifted Hilbert curves."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from plaudit.llm.common import in_groups
from plaudit.llm.vectors import doubles, matrix, unit
from plaudit.sources.shared import saved

# Curves, the dimensions and bits of each, and the share of all rows in a query's window.
CURVES = 16
DIMENSIONS = 6
BITS = 6
WINDOW = 0.06
# Rows of one run of a curve, and queries that look at them at a time.
RUN = 2048
QUERIES = 4096
# Rows that the runs' borders are taken from, at least ten for each run.
SAMPLE_ROWS = 50_000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer cells, a row each (Skilling's transform)."""
    x = cells.astype(np.uint64).T.copy()
    one, n = np.uint64(1), len(x)
    q = one << np.uint64(bits - 1)
    while q > 1:
        p = q - one
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            if i:
                x[i] ^= swap
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = one << np.uint64(bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) > 0, q - one, np.uint64(0))
        q >>= one
    x ^= turn
    keys = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            keys = (keys << one) | ((x[i] >> np.uint64(bit)) & one)
    return keys.astype(np.int64)


@dataclass
class Curves:
    """Random projections and shifts, by the number of components."""

    count: int = CURVES
    dimensions: int = DIMENSIONS
    bits: int = BITS

    def keys(self, rows: np.ndarray) -> np.ndarray:
        """One key per row and curve."""
        width = rows.shape[1]
        rng = np.random.default_rng(7919 + width)
        units = unit(rows)
        found = np.empty((len(rows), self.count), np.int64)
        for c in range(self.count):
            basis = np.linalg.qr(rng.standard_normal((width, min(self.dimensions, width))))[0]
            shift = rng.random(basis.shape[1])
            # Components of a random unit vector spread by 1 / sqrt(width): four of these each way.
            spot = (units @ basis) * np.sqrt(width) / 8 + 0.5 + (shift - 0.5) / 4
            cells = np.clip(spot * (1 << self.bits), 0, (1 << self.bits) - 1).astype(np.int64)
            found[:, c] = hilbert_keys(cells, self.bits)
        return found


def _keyed(points: DataFrame, curves: Curves) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lengths = np.array(batch.column(2).value_lengths())
                keys = np.empty((batch.num_rows, curves.count), np.int64)
                for length in np.unique(lengths):
                    at = np.flatnonzero(lengths == length)
                    keys[at] = curves.keys(matrix(batch.column(2).take(pa.array(at))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.tolist(), pa.list_(pa.int64()))], names=[*batch.schema.names, "keys"])

    return points.select("vec_id", "width", "vector", "spot").mapInArrow(
        run, "vec_id long, width int, vector array<double>, spot long, keys array<long>"
    )


def nearest(
    embeddings: DataFrame, every: int = 50, k: int = 5, window: float = WINDOW, curves: Curves | None = None
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of largest cosine found for each query.

    Queries are the rows whose vec_id is divisible by ``every``. All rows are projected onto a
    few random directions, ``CURVES`` times, and ordered along a shifted Hilbert curve in each.
    Borders from a bounded sample cut every order into runs of about ``RUN`` rows; Spark deals
    rows by (curve, run), and a query also goes to the runs around its own, which hold the share
    ``window`` of all rows. A run ranks its rows for its queries by the cosine on the original
    vectors; the best of all runs and curves are merged. Rows of one place on a curve are parted
    by a hash, so that no run can be filled by a crowd. Rows and queries of a run are dealt into
    blocks of bounded size, every block of rows meeting every block of queries, so that neither more
    vectors nor more queries make a group larger.

    The window is a share of the rows because unlike vectors of many dimensions have no closer
    neighbourhood to look in: recall is then the same at every size. Of equal vectors only the
    ``k`` + 1 with the smallest vec_id can be in an answer, and only they are indexed.

    Ties go to the smaller vec_id. Vectors that are null, empty, zero or hold null or non-finite
    components and rows without a vec_id take no part; vectors of other lengths are no
    candidates. A repeated vec_id is one candidate with each of its vectors, and its query is
    asked for each, the best answer first. An empty table gives no rows.
    """
    curves = curves or Curves()
    rows = doubles(embeddings.where("vec_id is not null"), F.col("vec_id").cast("long").alias("vec_id"))
    same = Window.partitionBy("vector").orderBy("vec_id")
    rows = rows.dropDuplicates(["vec_id", "vector"]).withColumn("copy", F.row_number().over(same))
    is_query = F.col("vec_id") % every == 0
    index = rows.where(F.col("copy") <= k + 1)
    spot = F.xxhash64("vec_id")
    points = saved(_keyed(index.select("vec_id", F.size("vector").alias("width"), "vector", spot.alias("spot")), curves))
    # A query among dropped copies is asked all the same.
    queries = saved(
        _keyed(
            rows.where(is_query).select("vec_id", F.size("vector").alias("width"), "vector", spot.alias("spot")), curves
        )
    )
    total = points.count()
    if not total:
        return points.select(
            F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")
        )
    borders = _borders(points, total, curves.count)
    runs = [len(b) + 1 for b in borders]
    row_blocks = -(-total // (RUN * min(runs))) if min(runs) > 1 else 1
    reached = queries.count() * min(1.0, window + 2 / min(runs))
    query_blocks = max(1, -(-int(reached) // QUERIES))

    def dealt(df: DataFrame, reach: bool, role: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, spots = matrix(batch.column(4)) if batch.num_rows else np.empty((0, curves.count)), batch.column(3).to_numpy()
                for c in range(curves.count if batch.num_rows else 0):
                    own = np.searchsorted(borders[c], _fine(keys[:, c], spots), "right")
                    around = -(-int(np.ceil(window * runs[c])) // 2) if reach and runs[c] > 1 else 0
                    for step in range(-around, around + 1):
                        there = own + step
                        if reach and runs[c] <= 2 * around + 1:
                            # The window holds the whole curve: every run once.
                            there = np.full(len(own), step + around) if step + around < runs[c] else np.full(len(own), -1)
                        elif reach:
                            # At an end of the curve the window keeps its size.
                            there = np.clip(own, around, runs[c] - 1 - around) + step
                        good = np.flatnonzero((there >= 0) & (there < runs[c]))
                        part = batch.take(pa.array(good))
                        run_ids = there[good] * curves.count + c
                        own_block, others = (spots[good] % query_blocks, row_blocks) if reach else (spots[good] % row_blocks, query_blocks)
                        for other in range(others):
                            rows_at, asked_at = (other, own_block) if reach else (own_block, other)
                            group = (run_ids * row_blocks + rows_at) * query_blocks + asked_at
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(group, pa.int64()), pa.array(np.full(len(group), role), pa.int32()), part.column(0), part.column(2)],
                                names=["run", "role", "vec_id", "vector"],
                            )

        return df.mapInArrow(run, "run long, role int, vec_id long, vector array<double>")

    def rank(run: pa.Table) -> Iterator[pa.RecordBatch]:
        role = run["role"].to_numpy()
        lengths = np.array(run["vector"].combine_chunks().value_lengths())
        for length in np.unique(lengths):
            asked, given = np.flatnonzero((role == 1) & (lengths == length)), np.flatnonzero((role == 0) & (lengths == length))
            if not len(asked) or not len(given):
                continue
            ids = run["vec_id"].to_numpy()
            left, right = (matrix(run["vector"].take(pa.array(at))) for at in (asked, given))
            for start in range(0, len(asked), 512):
                part = asked[start : start + 512]
                scores = unit(left[start : start + 512]) @ unit(right).T
                scores[ids[part][:, None] == ids[given][None, :]] = -np.inf
                keep = min(k, len(given))
                # All that tie with the last of the best, so that the smaller vec_id wins.
                last = np.partition(scores, len(given) - keep, axis=1)[:, len(given) - keep]
                q, c = np.nonzero((scores >= last[:, None] - 1e-9) & np.isfinite(scores))
                exact = _cosines(left[start : start + 512][q], right[c])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[part][q]), pa.array(ids[given][c]), pa.array(exact)], names=["query_id", "vec_id", "score"]
                )

    met = dealt(points, False, 0).unionByName(dealt(queries, True, 1))
    found = in_groups(met, "run", rank, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )


def _cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The cosine of each row of ``left`` with the row of ``right`` beside it."""
    dots = (left * right).sum(1)
    return dots / (np.sqrt((left * left).sum(1)) * np.sqrt((right * right).sum(1)))


def _fine(keys: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """The place on the curve, and below it a hash that parts rows of one place."""
    return (keys.astype(np.int64) << 20) | (spots.astype(np.int64) & ((1 << 20) - 1))


def _borders(points: DataFrame, total: int, count: int) -> list[np.ndarray]:
    """Per curve, the keys that cut it into runs, from at most about ``SAMPLE_ROWS`` rows' keys."""
    share = min(1.0, SAMPLE_ROWS / total)
    drawn = points.where(F.pmod(F.xxhash64("spot"), F.lit(1 << 30)) < int(share * (1 << 30))).select("keys", "spot")
    rows = drawn.limit(2 * SAMPLE_ROWS).toPandas()
    keys = np.array(rows["keys"].tolist(), np.int64).reshape(-1, count)
    runs = min(-(-total // RUN), SAMPLE_ROWS // 10)
    found = []
    for c in range(count):
        ordered = np.sort(_fine(keys[:, c], rows["spot"].to_numpy()))
        at = np.arange(1, runs) * len(ordered) // runs
        found.append(np.unique(ordered[at]) if len(ordered) else np.empty(0, np.int64))
    return found

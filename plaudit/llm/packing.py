"""Packing documents into sequences by non-negative least squares over the length histogram."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from plaudit.llm.common import row_ident, shares
from plaudit.sources.shared import saved

CONTEXT = 2048
# The id that ends each document, and the special token of the vocabulary, which a text may spell.
END_ID = 1
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
# Combinations of three lengths are enumerated among so many of the commonest lengths.
LENGTHS_IN_TRIPLES = 200
STEPS = 400
# Documents that are numbered together.
ROWS_TOGETHER = 20_000


class Encoder:
    """Text to ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._whole = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})

    def document(self, text: str | None) -> bytes:
        ids = self._whole.encode_to_numpy(text or "", allowed_special="all")
        return np.append(ids, END_ID).astype("<u4").tobytes()


def default_vocabulary() -> tuple[str, str]:
    """Path of the vocabulary's ranks and its pattern, as the public files give them."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _crc(ids: bytes, start: int, length: int) -> int:
    return zlib.crc32(ids[4 * start : 4 * (start + length)])


def _tokenised(docs: DataFrame, vocabulary: tuple[str, str], context: int) -> DataFrame:
    """``doc_id, ident, n, crcs``: a document's tokens, and a checksum per ``context`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(*vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                counts, crcs = [], []
                for text in part.column(2).to_pylist():
                    ids = encode.document(text)
                    counts.append(len(ids) // 4)
                    crcs.append([_crc(ids, start, context) for start in range(0, counts[-1], context)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))],
                    names=["doc_id", "ident", "n", "crcs"],
                )

    return docs.select(F.col("doc_id").cast("long"), row_ident().alias("ident"), "text").mapInArrow(
        run, "doc_id long, ident string, n long, crcs array<long>"
    )


def combinations(histogram: np.ndarray) -> np.ndarray:
    """Two or three lengths that fill a window, a row each; 0 stands for no third."""
    context = len(histogram)
    small = np.arange(1, context // 2 + 1)
    pairs = small[(histogram[small] > 0) & (histogram[context - small] > 0)]
    rows = [np.stack([pairs, context - pairs, np.zeros_like(pairs)], 1)]
    common = np.argsort(-histogram, kind="stable")[:LENGTHS_IN_TRIPLES]
    common = np.sort(common[histogram[common] > 0])
    one, two = (x.ravel() for x in np.meshgrid(common, common, indexing="ij"))
    three = context - one - two
    good = (one <= two) & (three >= two)
    one, two, three = one[good], two[good], three[good]
    good = histogram[three] > 0
    rows.append(np.stack([one[good], two[good], three[good]], 1))
    return np.concatenate(rows).astype(np.int64)


def least_squares(combos: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Repeats x >= 0 of the combinations with the least sum of squares of A x - histogram.

    Accelerated projected gradients; A is never built, it has three entries per column.
    """
    if not len(combos):
        return np.zeros(0)
    used = combos > 0
    flat, goal = combos[used], histogram.astype(float)

    def lengths_of(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, np.broadcast_to(x[:, None], combos.shape)[used], len(histogram))

    def gradient(x: np.ndarray) -> np.ndarray:
        off = lengths_of(x) - goal
        off[0] = 0
        return off[combos].sum(1)

    probe = np.ones(len(combos))
    for _ in range(20):
        norm = np.linalg.norm(probe)
        over = lengths_of(probe / norm)
        over[0] = 0
        probe = over[combos].sum(1)
    step = 1 / (1.05 * np.linalg.norm(probe))
    x, ahead, t = np.zeros(len(combos)), np.zeros(len(combos)), 1.0
    for _ in range(STEPS):
        new = np.maximum(0, ahead - step * gradient(ahead))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


class Plan:
    """Where the piece of a length and a rank goes.

    Combinations are repeated as the rounded solution says, the largest repeats first and as far
    as pieces last, then pairs that still fill a window; what remains is laid end to end, longest
    first, and cut at the windows. The last window, not full, is cut at powers of two.
    """

    def __init__(self, histogram: np.ndarray):
        context = self.context = len(histogram)
        left = histogram.astype(np.int64).copy()
        left[0] = 0
        taken = np.zeros(context, np.int64)
        spans, self.sequences = [], 0  # spans: length, first rank, first sequence, offset there
        combos = combinations(histogram)
        repeats = np.rint(least_squares(combos, histogram)).astype(np.int64)
        order = np.argsort(-repeats, kind="stable")
        greedy = np.stack([np.arange(1, context // 2 + 1), context - np.arange(1, context // 2 + 1)], 1)
        wanted = [(combos[i][combos[i] > 0], int(repeats[i])) for i in order if repeats[i]]
        for lengths, times in [*wanted, *((pair, int(left.max())) for pair in greedy)]:
            for length, each in zip(*np.unique(lengths, return_counts=True), strict=True):
                times = min(times, int(left[length]) // int(each))
            if times <= 0:
                continue
            offset = 0
            for length in lengths:
                spans.append((length, taken[length], self.sequences, offset))
                taken[length] += times
                left[length] -= times
                offset += length
            self.sequences += times
        self.rest_start = np.full(context, -1, np.int64)
        self.rest_from = taken.copy()
        at = 0
        for length in range(context - 1, 0, -1):
            self.rest_start[length] = at
            at += length * int(left[length])
        self.rest = at
        spans += [(length, taken[length], -1, 0) for length in range(1, context)]
        spans = np.array(sorted(spans), np.int64)
        self.keys = (spans[:, 0] << 44) + spans[:, 1]
        self.first_rank, self.first_sequence, self.offset = spans[:, 1], spans[:, 2], spans[:, 3]
        edges, end = list(range(0, at - at % context + 1, context))[-1:], at
        while edges[-1] < end:
            edges.append(edges[-1] + (1 << ((end - edges[-1]).bit_length() - 1)))
        self.last_edges = edges

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """``(start in the piece, length, sequence, offset)`` of each part; one unless it is cut."""
        i = int(np.searchsorted(self.keys, (length << 44) + rank, "right")) - 1
        if self.first_sequence[i] >= 0:
            return [(0, length, int(self.first_sequence[i]) + rank - int(self.first_rank[i]), int(self.offset[i]))]
        start = int(self.rest_start[length]) + (rank - int(self.rest_from[length])) * length
        parts, at, end = [], start, start + length
        tail, full = self.last_edges[0], self.last_edges[0] // self.context
        while at < end:
            if at < tail:
                number, begin, stop = at // self.context, at - at % self.context, at - at % self.context + self.context
            else:
                k = int(np.searchsorted(self.last_edges, at, "right")) - 1
                number, begin, stop = full + k, self.last_edges[k], self.last_edges[k + 1]
            stop = min(stop, end)
            parts.append((at - start, stop - at, self.sequences + number, at - begin))
            at = stop
        return parts


def packed(docs: DataFrame, vocabulary: tuple[str, str] | None = None, context: int = CONTEXT) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` for each piece of ``docs(doc_id, text)``.

    Whole windows of a document are sequences of their own; its last, shorter piece is packed.
    The histogram of these lengths, ``context`` numbers, is all that the driver sees: lengths
    that fill a window together are enumerated, non-negative least squares finds how often, and
    what is left is packed greedily, with cuts. Every piece finds its place from its length and
    its rank among pieces of that length, which is counted in shares of the rows. Texts are
    tokenised once; only those of cut pieces again.

    A null or empty text is one token, the end. Repeated rows are packed each. An empty table
    gives no rows. Other columns are ignored.
    """
    vocabulary = vocabulary or default_vocabulary()
    tokens = saved(_tokenised(docs, vocabulary, context))
    rows = tokens.withColumn("tail", F.col("n") % context).withColumn(
        "share", F.pmod(F.xxhash64("ident"), F.lit(shares(tokens, ROWS_TOGETHER)))
    )
    counts = saved(
        rows.groupBy("tail", "share").agg(F.count("*").alias("docs"), F.sum(F.floor(F.col("n") / context)).alias("windows"))
    )
    histogram = np.zeros(context, np.int64)
    windows = 0
    for row in counts.groupBy("tail").agg(F.sum("docs").alias("docs"), F.sum("windows").alias("windows")).collect():
        histogram[row["tail"]] = row["docs"]
        windows += row["windows"]
    plan = Plan(histogram)

    before = Window.partitionBy("tail").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("tail", "share", F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("rank_from"))
    per_share = counts.groupBy("share").agg(F.sum("windows").alias("windows"))
    before = Window.partitionBy(F.lit(0)).orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    firsts = per_share.select("share", F.coalesce(F.sum("windows").over(before), F.lit(0)).alias("window_from"))
    own = Window.partitionBy("share").orderBy("tail", "ident").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("share", "tail").orderBy("ident")
    placed = (
        rows.withColumn("window", F.coalesce(F.sum(F.floor(F.col("n") / context)).over(own), F.lit(0)))
        .withColumn("rank", F.row_number().over(same) - 1)
        .join(ranks, ["tail", "share"])
        .join(firsts, "share")
        .select(
            "doc_id",
            "ident",
            "n",
            "crcs",
            (F.col("window") + F.col("window_from")).cast("long").alias("window"),
            (F.col("rank") + F.col("rank_from")).cast("long").alias("rank"),
        )
    )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, ident, n, crcs, window, rank in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                full, tail = divmod(n, context)
                out += [(doc_id, ident, k * context, context, crcs[k], n, window + k, 0) for k in range(full)]
                parts = plan.place(tail, rank) if tail else []
                for start, length, sequence, offset in parts:
                    crc = crcs[full] if len(parts) == 1 else None
                    out.append((doc_id, ident, full * context + start, length, crc, n, windows + sequence, offset))
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 6]
            columns = list(zip(*out, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "ident", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    schema = "doc_id long, ident string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    found = saved(placed.mapInArrow(pieces, schema))
    cut = found.where("ids_crc32 is null")
    return found.where("ids_crc32 is not null").unionByName(_checksums(cut, docs, vocabulary)).drop("ident")


def _checksums(cut: DataFrame, docs: DataFrame, vocabulary: tuple[str, str]) -> DataFrame:
    """The cut pieces with their checksums, from their documents' texts."""
    texts = docs.select(row_ident().alias("ident"), "text").join(cut.select("ident").distinct(), "ident", "left_semi")
    rows = cut.join(texts.dropDuplicates(["ident"]), "ident").select(*cut.columns, "text")
    at = {name: i for i, name in enumerate(cut.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(*vocabulary)
        for batch in batches:
            starts, lengths = (batch.column(at[c]).to_pylist() for c in ("start", "length"))
            texts = batch.column(len(at)).to_pylist()
            crcs = [_crc(encode.document(t), s, n) for t, s, n in zip(texts, starts, lengths, strict=True)]
            columns = list(batch.columns[: len(at)])
            columns[at["ids_crc32"]] = pa.array(crcs, pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names=list(at))

    return rows.mapInArrow(run, cut.schema)

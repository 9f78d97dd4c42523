"""Removal of passages that documents repeat from earlier ones, by anchors at the places of a difference cover."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plaudit.llm.common import in_groups
from plaudit.llm.minhash import _WordHashes

WINDOW = 13
# Perfect difference sets by their period. For any two places there is a shift below the
# period that takes both to places of the set.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 6, 8, 18)}
# Text that is looked at together, and fingerprints that meet in one group.
BLOCK_BYTES = 4 << 20
CELL_PRINTS = 1 << 20
# An anchor's fingerprint travels with its upper 48 bits; a false match is undone by the windows' own.
ANCHOR_BYTES = 6

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


def cover_of(window: int) -> tuple[int, tuple[int, ...], int]:
    """Period, places and anchor length for matches of ``window`` words: the longest period that leaves
    anchors half a window long."""
    period = max((p for p in COVERS if window - p + 1 >= window / 2), default=1)
    return period, COVERS.get(period, (0,)), window - period + 1


def _grams(words: np.ndarray, n: int, factor: np.uint64) -> np.ndarray:
    """A fingerprint of the ``n`` words from each place on; of the places that have so many."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    mixed = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        mixed = mixed * factor + words[i : len(words) - n + 1 + i]
    mixed ^= mixed >> np.uint64(32)
    mixed *= factor
    mixed ^= mixed >> np.uint64(29)
    return mixed


def words_of(text: str | None) -> list[bytes]:
    """The words between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").split()


class Block:
    """The words of some documents in a row, in the order of (doc_id, text)."""

    def __init__(self, rows: pa.Table, hashes: dict, window: int):
        order = [("doc_id", "ascending"), ("text", "ascending")]
        self.rows = rows.select(["doc_id", "text"]).sort_by(order)
        self.ids = self.rows["doc_id"].to_numpy()
        self.window = window
        codes = [self._codes(text.as_py(), hashes) for text in self.rows["text"]]
        self.sizes = np.array([len(c) for c in codes], np.int64)
        self.words = np.concatenate([*codes, np.empty(0, np.uint64)])
        ends = np.cumsum(self.sizes)
        self.doc = np.repeat(np.arange(len(codes)), self.sizes)
        self.place = np.arange(len(self.words)) - np.repeat(ends - self.sizes, self.sizes)
        # Words from each place to the end of its document.
        self.left = np.repeat(self.sizes, self.sizes) - self.place

    @staticmethod
    def _codes(text: str | None, hashes: dict) -> np.ndarray:
        parts = words_of(text)
        return np.fromiter(map(hashes.__getitem__, parts), np.uint64, len(parts))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of the anchors and where they stand. Documents shorter than a window have none."""
        period, places, length = cover_of(self.window)
        prints = _grams(self.words, length, _PRIME)
        n = len(prints)
        at = np.flatnonzero(np.isin(self.place[:n] % period, places) & (self.left[:n] >= length) & (self.sizes[self.doc[:n]] >= self.window))
        drop = np.uint64(64 - 8 * ANCHOR_BYTES)
        return prints[at] >> drop << drop, at

    def candidates(self, at: np.ndarray) -> np.ndarray:
        """The windows around the anchors ``at``, which say where they may be repeated."""
        length = cover_of(self.window)[2]
        found = np.zeros(len(self.words), bool)
        for k in range(self.window - length + 1):
            from_ = at[self.place[at] >= k] - k
            found[from_] = True
        return found & (self.left >= self.window)

    def windows(self, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first 64 and other 32 bits of the fingerprint of the windows that ``where`` marks."""
        at = np.flatnonzero(where)
        other = _grams(self.words, self.window, _OTHER)[at] >> np.uint64(32)
        return _grams(self.words, self.window, _PRIME)[at], other.astype(np.uint32)


class Distinct:
    """Different values of ``keys`` in their order: ``first`` and ``last`` occurrence, and each one's ``number``."""

    def __init__(self, *keys: np.ndarray):
        order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        starts = np.flatnonzero(new)
        ends = np.append(starts, len(order))[1:]
        self.order, self.starts = order, starts
        self.first, self.last = order[starts], order[ends - 1]
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1


def _cells(prints: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """``cell, start, end`` of the runs of sorted fingerprints with the same upper bits."""
    cells = (prints >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(prints), np.int64)
    starts = np.flatnonzero(np.append(len(cells) > 0, cells[1:] != cells[:-1]))
    ends = np.append(starts, len(cells))[1:]
    return list(zip(cells[starts].tolist(), starts.tolist(), ends.tolist(), strict=True))


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


def _short(prints: np.ndarray) -> bytes:
    return prints.view(np.uint8).reshape(-1, 8)[:, 8 - ANCHOR_BYTES :].tobytes()


def _long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // ANCHOR_BYTES, 8), np.uint8)
    out[:, 8 - ANCHOR_BYTES :] = np.frombuffer(data, np.uint8).reshape(-1, ANCHOR_BYTES)
    return out.reshape(-1).view(np.uint64)


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _shared_anchors(blocks: DataFrame, window: int, bits: int) -> DataFrame:
    """``block, cell, flags``: which of a block's anchors, in the order of their fingerprints, other
    documents have as well.

    A block sends each different anchor once, with the mark of those that two of its own documents
    have, so that an anchor of very many documents comes once from each block.
    """
    hashes = _WordHashes()
    schema = pa.schema([("cell", pa.int64()), ("block", pa.int64()), ("prints", pa.binary()), ("flags", pa.binary())])

    def ask(key: tuple, rows: pa.Table) -> pa.Table:
        block = Block(rows, hashes, window)
        prints, at = block.anchors()
        own = Distinct(prints)
        # Occurrences stand in the order of doc_id, so the first and last tell.
        several = block.ids[block.doc[at[own.first]]] != block.ids[block.doc[at[own.last]]]
        prints = prints[own.first]
        found = [(cell, key[0].as_py(), _short(prints[a:b]), _bits(several[a:b])) for cell, a, b in _cells(prints, bits)]
        return _table(schema, found)

    asked = blocks.groupBy("block").applyInArrow(ask, "cell long, block long, prints binary, flags binary")
    reply = pa.schema([("block", pa.int64()), ("cell", pa.int64()), ("flags", pa.binary())])

    def meet(group: pa.Table) -> Iterator[pa.RecordBatch]:
        parts = [_long(x) for x in group["prints"].to_pylist()]
        sizes = [len(p) for p in parts]
        several = np.concatenate([_flags(f, n) for f, n in zip(group["flags"].to_pylist(), sizes, strict=True)])
        both = Distinct(np.concatenate(parts))
        shared = (both.first != both.last) | np.maximum.reduceat(several[both.order], both.starts)
        shared = np.split(shared[both.number], np.cumsum(sizes)[:-1])
        rows = zip(group["block"].to_pylist(), group["cell"].to_pylist(), map(_bits, shared), strict=True)
        yield from _table(reply, list(rows)).to_batches()

    return in_groups(asked, "cell", meet, "block long, cell long, flags binary")


def _repeated_windows(blocks: DataFrame, shared: DataFrame, window: int, bits: int) -> DataFrame:
    """``block, cell, flags``: which of a block's windows around shared anchors, in the order of their
    fingerprints, start in a smaller document of another block.

    A row of cell -1 marks the places of these windows in the block.
    """
    hashes = _WordHashes()
    schema = pa.schema([(c, pa.int64()) for c in ("cell", "block", "place")] + [(c, pa.binary()) for c in ("prints", "others", "least")])

    def ask(key: tuple, rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema.empty_table()
        block = Block(rows, hashes, window)
        prints, at = block.anchors()
        own = Distinct(prints)
        marked = block.candidates(at[_answered(replies, prints[own.first], bits)[own.number]])
        prints, others = block.windows(marked)
        own = Distinct(prints, others)
        least = block.ids[block.doc[np.flatnonzero(marked)[own.first]]]
        prints, others = prints[own.first], others[own.first]
        number = key[0].as_py()
        found = [
            (cell, number, cell, prints[a:b].tobytes(), others[a:b].tobytes(), least[a:b].tobytes()) for cell, a, b in _cells(prints, bits)
        ]
        if marked.any():
            found.append((number % (1 << bits), number, -1, _bits(marked), None, None))
        return _table(schema, found)

    asked = (
        blocks.groupBy("block")
        .cogroup(shared.groupBy("block"))
        .applyInArrow(ask, "cell long, block long, place long, prints binary, others binary, least binary")
    )
    reply = pa.schema([("block", pa.int64()), ("cell", pa.int64()), ("flags", pa.binary())])

    def meet(group: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = group.to_pylist()
        marks = [(r["block"], -1, r["prints"]) for r in rows if r["place"] < 0]
        yield from _table(reply, marks).to_batches()
        rows = [r for r in rows if r["place"] >= 0]
        if not rows:
            return
        prints, others, least = (
            np.concatenate([np.frombuffer(r[c], kind) for r in rows]) for c, kind in (("prints", "<u8"), ("others", "<u4"), ("least", "<i8"))
        )
        both = Distinct(prints, others)
        smallest = np.minimum.reduceat(least[both.order], both.starts)
        earlier = np.split(smallest[both.number] < least, np.cumsum([len(r["prints"]) // 8 for r in rows])[:-1])
        yield from _table(reply, [(r["block"], r["place"], _bits(e)) for r, e in zip(rows, earlier, strict=True)]).to_batches()

    return in_groups(asked, "cell", meet, "block long, cell long, flags binary")


def _answered(replies: pa.Table, prints: np.ndarray, bits: int) -> np.ndarray:
    """The flags of a block's sorted fingerprints, put together from the cells."""
    of = dict(zip(replies["cell"].to_pylist(), replies["flags"].to_pylist(), strict=True))
    return np.concatenate([np.empty(0, bool), *(_flags(of[cell], b - a) for cell, a, b in _cells(prints, bits))])


RESULT = "doc_id long, n_words long, n_removed long, text string, removed array<struct<start:long,end:long>>"
_ROWS = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())]
    + [("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)


def _kept(ids: pa.Array, texts: list[str | None], sizes: np.ndarray, gone: np.ndarray) -> pa.Table:
    """The result's rows; ``gone`` marks the words, of all texts in a row, that go."""
    ends = np.cumsum(sizes)
    kept, removed, spans = [], [], []
    for text, a, b in zip(texts, (ends - sizes).tolist(), ends.tolist(), strict=True):
        own = gone[a:b]
        parts = words_of(text)
        removed.append(int(own.sum()))
        if removed[-1]:
            parts = [parts[i] for i in np.flatnonzero(~own).tolist()]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))).tolist()
            spans.append([{"start": x, "end": y} for x, y in zip(edges[::2], edges[1::2], strict=True)])
        else:
            spans.append([])
        kept.append(b" ".join(parts).decode("utf-8", "surrogatepass"))
    columns = [ids, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, _ROWS.field("removed").type)]
    return pa.Table.from_arrays(columns, schema=_ROWS)


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, text, removed`` for every row of ``docs(doc_id, text)``.

    A word goes if a window of ``window`` consecutive words that covers it also starts in a document
    with a smaller doc_id. ``text`` holds the words that stay, joined by spaces, and ``removed`` the
    word places (start, end) of what went. Only anchors are compared over all the data: the words at
    places of a difference cover, modulo its period, as many as any repeated window shares at one
    shift with each of its repetitions. Windows around anchors that two documents share are
    then compared by a fingerprint of 96 bits.

    Documents are dealt once into blocks by hash, and all steps read that one exchange. What blocks
    tell each other is grouped by ranges of fingerprints, each block's different ones once, and answers
    are one bit for each, so that passages in very many documents make neither pairs nor large groups.

    Null texts have no words. A null doc_id is smaller and larger than none: such rows stay whole.
    Rows that repeat a doc_id take nothing from each other. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    # Anchors stand at a part of the words, which are some five bytes long with the space behind them.
    period, places, _ = cover_of(window)
    bits = max(0, int(size * len(places) / period / 5 / CELL_PRINTS).bit_length())
    parts = max(n, int(spark.conf.get("spark.sql.shuffle.partitions")))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("block")
    blocks = rows.where("doc_id is not null").select("doc_id", "text", block).repartition(parts, "block")
    shared = _shared_anchors(blocks, window, bits)
    repeated = _repeated_windows(blocks, shared, window, bits)
    hashes = _WordHashes()

    def remove(key: tuple, group: pa.Table, replies: pa.Table) -> pa.Table:
        if not group.num_rows:
            return _ROWS.empty_table()
        own = Block(group, hashes, window)
        steps = np.zeros(len(own.words) + 1, np.int64)
        marks = [r["flags"] for r in replies.to_pylist() if r["cell"] < 0]
        if marks:
            marked = _flags(marks[0], len(own.words))
            prints, others = own.windows(marked)
            different = Distinct(prints, others)
            earlier = _answered(replies, prints[different.first], bits)[different.number]
            at = np.flatnonzero(marked)
            ids = own.ids[own.doc[at]]
            goes = at[earlier | (ids > ids[different.first][different.number])]
            steps[goes] += 1
            steps[goes + window] -= 1
        return _kept(own.rows["doc_id"].combine_chunks(), own.rows["text"].to_pylist(), own.sizes, np.cumsum(steps)[:-1] > 0)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = np.array([len(words_of(t)) for t in texts], np.int64)
            yield from _kept(batch.column(0), texts, sizes, np.zeros(sizes.sum(), bool)).to_batches()

    found = blocks.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(remove, RESULT)
    return found.unionByName(rows.where("doc_id is null").mapInArrow(whole, RESULT))

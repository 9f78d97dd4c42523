"""Near-duplicate documents by MinHash, banding and exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from plaudit.llm.common import components, in_groups, shares, stored
from plaudit.operators.skew import hot_keys, split_join
from plaudit.sources.shared import fresh_path, saved, scratch

# 48 bands of 6 minima: a pair at similarity 0.8 shares no band once in two million.
BANDS = 48
ROWS = 6
HASHES = BANDS * ROWS
# Pairs whose signatures agree in a smaller share are not compared further. At a true 0.8 the
# share has a standard deviation of 0.024, so this is six of them below.
SIGNATURE_FLOOR = 0.66
# Rows, and shingles of rows, that one task compares with as many others at a time.
BLOCK = 2048
BLOCK_SHINGLES = 4_000_000
# Words whose hashes a task keeps; a speed setting only.
WORDS_KEPT = 400_000
# Sets whose bands and links go into one file of a table.
SETS_TOGETHER = 4096
# Bits, 4 MB, that mark the documents whose texts are wanted.
SIEVE_BITS = 1 << 25

_PRIME = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, words: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit fingerprints of the ``words``-word shingles of a text.

    A-Z become lower case; words lie between ASCII white space. A shorter text is one shingle.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    one = np.fromiter(map(hashes.__getitem__, parts), np.uint64, len(parts))
    size = min(words, len(one))
    mixed = np.full(len(one) - size + 1, size, np.uint64)
    for i in range(size):
        mixed = mixed * _PRIME + one[i : len(one) - size + 1 + i]
    mixed ^= mixed >> np.uint64(32)
    mixed *= _PRIME
    mixed ^= mixed >> np.uint64(29)
    mixed.sort()
    return mixed[np.append(True, mixed[1:] != mixed[:-1])]


def _universal() -> tuple[np.ndarray, np.ndarray]:
    """Factors (odd) and summands of the universal hashes x -> a x + b on 32 bits."""
    rng = np.random.default_rng(20240229)
    factors = rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)
    return factors.astype(np.uint32)[:, None], rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(
        np.uint32
    )[:, None]


def signature(shingles: np.ndarray, factors: np.ndarray, summands: np.ndarray) -> bytes:
    """The last byte of each hash's minimum over the set."""
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(values), 2048):
        hashed = values[None, start : start + 2048] * factors
        hashed += summands
        np.minimum(least, hashed.min(1), out=least)
    return least.astype(np.uint8).tobytes()


def signatures(docs: DataFrame, words: int = 2, ident: str | None = None) -> DataFrame:
    """``doc_id, n_shingles, print, sig`` and the column ``ident``: the print is a 128-bit fingerprint of the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (factors, summands) = _WordHashes(), _universal()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                sizes, prints, sigs = [], [], []
                for text in part.column(1).to_pylist():
                    own = shingle_set(text, words, hashes)
                    sizes.append(len(own))
                    prints.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                    sigs.append(signature(own, factors, summands) if len(own) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.binary())],
                    names=["doc_id", "ident", "n_shingles", "print", "sig"],
                )

    known = F.col(ident).cast("string") if ident else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long"), "text", known.alias("ident")).mapInArrow(
        run, "doc_id long, ident string, n_shingles long, print binary, sig binary"
    )


def _sifted(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``texts(text_id, text)`` that may be among ``wanted(first_id)``, before they are shuffled.

    The sieve is a bitmap of fixed size. With very many wanted ids it lets most rows through; none
    that is wanted is ever held back.
    """

    def bit(name: str):
        return F.pmod(F.xxhash64(name), F.lit(SIEVE_BITS)) + 1

    marks = wanted.select(bit("first_id").alias("bit"))
    sieve = marks.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    held = texts.withColumn("bit", bit("text_id"))
    held = held.withColumns({"bucket": F.bitmap_bucket_number("bit"), "place": F.bitmap_bit_position("bit").cast("int")})
    byte = F.conv(F.hex(F.substring("map", F.floor(F.col("place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.expr("shiftright(byte, place % 8) & 1") == 1
    met = held.join(F.broadcast(sieve), "bucket").withColumn("byte", byte)
    return met.where(is_set).select("text_id", "text")


def _full_sets(reps: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """``node, shingles`` of the sets ``reps(node, print, first_id)``, from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                nodes, sets = [], []
                for node, own_print, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    own = shingle_set(text, words, hashes)
                    # Another row may carry the same doc_id and a different text.
                    if len(own) and xxhash.xxh3_128_digest(own.tobytes()) == own_print:
                        nodes.append(node)
                        sets.append(own.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
                    names=["node", "shingles"],
                )

    texts = _sifted(docs.select(F.col("doc_id").cast("long").alias("text_id"), "text"), reps)
    found = reps.join(texts, F.col("first_id").eqNullSafe(F.col("text_id"))).select("node", "print", "text")
    return found.mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


@F.pandas_udf(DoubleType())
def _agreement(left, right):
    import pandas as pd

    if not len(left):
        return pd.Series([], dtype="float64")
    one = np.frombuffer(b"".join(left), np.uint8).reshape(-1, HASHES)
    two = np.frombuffer(b"".join(right), np.uint8).reshape(-1, HASHES)
    return pd.Series((one == two).mean(1))


def _confirmed(pairs: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose signatures agree well enough and whose full sets do agree."""
    for side in ("a", "b"):
        pairs = pairs.join(sigs.select(F.col("node").alias(side), F.col("sig").alias(f"sig_{side}")), side)
    pairs = pairs.where(_agreement("sig_a", "sig_b") >= SIGNATURE_FLOOR).select("a", "b")
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("shingles").alias(f"set_{side}")), side)
    both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    union = F.size("set_a").cast("long") + F.size("set_b").cast("long") - both
    return pairs.where(100 * both >= percent * union).select("a", "b")


def _ordered(a: str, b: str) -> list:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def _blocked(rows: DataFrame, group: str, stats: DataFrame, payload: list[str]) -> DataFrame:
    """``block, guest`` and the payload: every block of a group's rows beside every block of its guests.

    ``stats(group, n, top, rows_in, guests_in)`` says how many blocks there are. Guests are rows
    outside the group's commonest component: only they can add a link between components.
    """
    # A bucket or cluster may hold a third of all rows.
    rows = split_join(rows, stats.drop("n"), [group], hot_keys(stats.select(group, "n")), ["node"])
    spot, zero = F.xxhash64("node"), F.lit(0).cast("long")
    mine = rows.select(
        group, *payload, F.lit(0).alias("guest"), F.pmod(spot, "rows_in").alias("i"), F.explode(F.sequence(zero, F.col("guests_in") - 1)).alias("j")
    )
    guests = rows.where("label <> top").select(
        group, *payload, F.lit(1).alias("guest"), F.explode(F.sequence(zero, F.col("rows_in") - 1)).alias("i"), F.pmod(spot, "guests_in").alias("j")
    )
    block = F.concat_ws(":", F.col(group).cast("string"), "i", "j")
    return mine.unionByName(guests).select(block.alias("block"), "guest", *payload)


def _stats(rows: DataFrame, group: str, size: str) -> DataFrame:
    per_label = rows.groupBy(group, "label").agg(F.count("*").alias("n"), F.sum(size).alias("size"))
    most = F.max_by(F.struct("label", "n", "size"), F.struct("n", "label"))
    whole = per_label.groupBy(group).agg(F.sum("n").alias("n"), F.sum("size").alias("size"), most.alias("most"), F.count("*").alias("labels"))

    def blocks(n, size):
        return F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES), F.lit(1)).cast("long")

    return whole.where("labels > 1").select(
        group,
        "n",
        F.col("most.label").alias("top"),
        blocks(F.col("n"), F.col("size")).alias("rows_in"),
        blocks(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("guests_in"),
    )


class _Forest:
    """Joins the things of one block; says which joins were new."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def _codes(block: pa.Table) -> tuple[np.ndarray, np.ndarray, _Forest]:
    """Guests, a number for each row's component, and a forest that knows these components."""
    names: dict[int, int] = {}
    codes = np.array([names.setdefault(x, len(names)) for x in block["label"].to_pylist()])
    return block["guest"].to_numpy().astype(bool), codes, _Forest(len(names))


def _edges(found: list[tuple[int, int]], nodes: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([nodes[x] for x, _ in found], pa.int64()), pa.array([nodes[y] for _, y in found], pa.int64())], names=["a", "b"]
    )


def _maybe(bands: DataFrame, labels: DataFrame, sigs: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` that join components whose rows share a band and agree in signature.

    Not all such pairs: each block gives a spanning forest of them.
    """
    rows = bands.join(labels, "node").withColumn("size", F.lit(0))
    blocks = _blocked(rows.join(sigs, "node"), "bucket", saved(_stats(rows, "bucket", "size")), ["node", "label", "sig"])

    def compare(block: pa.Table) -> Iterator[pa.RecordBatch]:
        guest, codes, forest = _codes(block)
        sigs_ = np.frombuffer(b"".join(block["sig"].to_pylist()), np.uint8).reshape(-1, HASHES)
        rows_at, found = np.flatnonzero(~guest), []
        for g in np.flatnonzero(guest).tolist():
            others = rows_at[codes[rows_at] != codes[g]]
            near = others[(sigs_[others] == sigs_[g]).sum(1) >= SIGNATURE_FLOOR * HASHES]
            for code, at in zip(*np.unique(codes[near], return_index=True), strict=True):
                if forest.join(int(codes[g]), int(code)):
                    found.append((g, int(near[at])))
        yield _edges(found, block["node"].to_pylist())

    return in_groups(blocks, "block", compare, "a long, b long").select(*_ordered("a", "b")).distinct()


def _bridges(maybe: DataFrame, stars: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join components, by comparing the full sets within each cluster of what may be linked.

    A cluster holds all rows that ``stars`` of linked rows and ``maybe`` edges connect. Its guests are compared with
    all its rows, block by block, over an index of the block's shingles, and a block gives a
    spanning forest of the links found.
    """
    reached = components(stars.unionByName(maybe)).withColumnRenamed("label", "cluster")
    rows = saved(labels.join(reached, "node").join(sets.select("node", F.size("shingles").cast("long").alias("size")), "node"))
    blocks = _blocked(rows.join(sets, "node"), "cluster", saved(_stats(rows, "cluster", "size")), ["node", "label", "shingles"])

    def compare(block: pa.Table) -> Iterator[pa.RecordBatch]:
        guest, codes, forest = _codes(block)
        sets_ = block["shingles"].combine_chunks()
        starts = sets_.offsets.to_numpy()
        values = sets_.values.to_numpy()
        rows_at, found = np.flatnonzero(~guest), []
        own = [values[starts[i] : starts[i + 1]] for i in range(len(guest))]
        sizes = np.diff(starts)
        if len(rows_at) and guest.any():
            index = np.concatenate([own[i] for i in rows_at])
            owner = np.repeat(np.arange(len(rows_at)), sizes[rows_at])
            order = np.argsort(index, kind="stable")
            index, owner = index[order], owner[order]
            for g in np.flatnonzero(guest).tolist():
                low, high = np.searchsorted(index, own[g], "left"), np.searchsorted(index, own[g], "right")
                many = high - low
                hits = np.repeat(low - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
                both = np.bincount(owner[hits], minlength=len(rows_at))
                linked = rows_at[100 * both >= percent * (sizes[rows_at] + sizes[g] - both)]
                for code, at in zip(*np.unique(codes[linked], return_index=True), strict=True):
                    if forest.join(int(codes[g]), int(code)):
                        found.append((g, int(linked[at])))
        yield _edges(found, block["node"].to_pylist())

    return in_groups(blocks, "block", compare, "a long, b long").select(*_ordered("a", "b")).distinct()


def _classes(docs: DataFrame, words: int, ident: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of :func:`signatures` without signatures, and the different sets, ``print, first_id, sig, copies, node``.

    A short number, ``node``, stands for a set from here on; it is stored, so it stays the same.
    """
    spark = docs.sparkSession
    rows_path, classes_path = fresh_path(spark, "table"), fresh_path(spark, "table")
    with scratch(spark):
        marked = saved(signatures(docs, words, ident))
        classes = (
            marked.where("print is not null")
            .groupBy("print")
            .agg(F.min("doc_id").alias("first_id"), F.min("sig").alias("sig"), F.count("*").alias("copies"))
            .withColumn("node", F.monotonically_increasing_id())
        )
        return stored(marked.drop("sig"), rows_path), stored(classes, classes_path)


def _labelled(classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``print, first_id, copies, node, label`` of the sets ``classes``; linked sets have one label."""
    # Tables have no more files than their rows need: each costs a task and a few calls of the file system.
    files = shares(classes, SETS_TOGETHER)

    def kept(df: DataFrame) -> DataFrame:
        return saved(df.coalesce(files))

    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    bands = classes.select("node", "sig", band.alias("band")).select(
        "node", F.xxhash64("band", F.expr(f"substring(sig, band * {ROWS} + 1, {ROWS})")).alias("bucket")
    )
    shared = bands.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    # Spark takes the rows of an explode for as many as before it, 48 times too few, and would broadcast them.
    bands = kept(bands.hint("merge").join(shared, "bucket"))
    reps = kept(bands.select("node").distinct().join(classes, "node"))
    sets = kept(_full_sets(reps.select("node", "print", "first_id"), docs, words))
    sigs = reps.select("node", "sig")

    stars = bands.select("node", F.explode(F.array("low", "high")).alias("centre")).where("node <> centre")
    pairs = kept(stars.select(*_ordered("node", "centre")).distinct())
    links = kept(_confirmed(pairs, sigs, sets, percent))
    found = components(links, files)
    labels = sigs.select("node").join(found, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    labels = kept(labels)
    maybe = kept(_maybe(bands.select("node", "bucket"), labels, sigs))
    # Without edges that may join components there is nothing more to compare.
    if maybe.limit(1).count():
        # Stars stand for the links they come from: far fewer, and most rounds are behind them.
        stars = kept(found.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")))
        more = kept(_bridges(maybe, stars, labels, sets, percent))
        if more.limit(1).count():
            found = components(stars.unionByName(more), files)
    return classes.join(found, "node", "left").select("print", "first_id", "copies", "node", F.coalesce("label", "node").alias("label"))


def near_duplicates(docs: DataFrame, words: int = 2, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``.

    Documents are linked when 100 * common shingles >= ``percent`` * shingles of both. Equal sets
    are one node. Each node gets 288 universal hash minima in 48 bands. Every band's bucket links
    its rows with its smallest and its largest node; pairs that pass the signature check are
    confirmed on the full sets. What the buckets hold besides, pairs of different components, is
    compared by signature and then on the full sets inside tasks, block by block, and only edges
    that join components come out: no link that does is lost in a large bucket, and no bucket is
    expanded into pairs. All tables but the result go when it is stored.

    Null or wordless texts have no shingles and link with nothing. Repeated rows are repeated in
    the result. A null doc_id takes part, is no component's id while another has one, and is never
    kept. An empty table gives an empty result; other columns are ignored.
    """
    path = fresh_path(docs.sparkSession, "table")
    with scratch(docs.sparkSession):
        marked, classes = _classes(docs, words)
        labelled = saved(_labelled(classes, docs, words, percent))
        least = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
        named = labelled.join(least, "label").select("print", "component_id")
        # Documents of one set may be very many.
        hot = hot_keys(labelled.select("print", F.col("copies").alias("n")))
        rows = marked.select("doc_id", "n_shingles", "print")
        joined = split_join(rows.where("print is not null"), named, ["print"], hot, ["doc_id"])
        alone = rows.where("print is null").withColumn("component_id", F.col("doc_id"))
        result = joined.unionByName(alone).select("doc_id", "n_shingles", "component_id")
        return stored(result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))), path)


def representatives(docs: DataFrame, ident: str, words: int = 2, percent: int = 80) -> DataFrame:
    """``ident`` of one row of each group of near duplicates of ``docs(doc_id, text, ident)``.

    It is that with the smallest doc_id, any before null, and then the smallest ``ident``, which tells
    rows apart that share a doc_id. Rows without words are in no group. Otherwise like :func:`near_duplicates`.
    """
    path = fresh_path(docs.sparkSession, "table")
    with scratch(docs.sparkSession):
        marked, classes = _classes(docs, words, ident)
        order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "ident")
        first = marked.where("print is not null").groupBy("print").agg(F.min(order).alias("first"))
        labelled = _labelled(classes, docs, words, percent).select("print", "label")
        chosen = labelled.join(first, "print").groupBy("label").agg(F.min("first").alias("first"))
        return stored(chosen.select(F.col("first.ident").alias(ident)), path)

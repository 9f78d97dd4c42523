"""Alignment of two tokenizers' tokens by pointer jumping, and corpus-wide counts of the ids it links."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

# Text whose links share one dictionary.
BLOCK_BYTES = 1 << 20
# Groups with more links than this are linked by their different ids.
LARGE_GROUP = 4096
# Fixed value: the mark that stands for a space in pieces.
MARK = "▁"


def default_vocabularies() -> tuple[str, str, str]:
    """Ranks and pattern of the byte-level vocabulary (A), and the model of the pieces (B)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")


class Tokenizers:
    """Ids of both tokenizers, and the bytes that each id stands for."""

    def __init__(self, ranks_path: str, pattern: str, model_path: str):
        import sentencepiece
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._a = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._b = model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.a_bytes[rank] = token
        # A piece of a single byte names it in hexadecimal digits.
        self.b_bytes = [
            bytes([int(piece[3:-1], 16)]) if model.is_byte(i) else piece.replace(MARK, " ").encode()
            for i, piece in enumerate(map(model.id_to_piece, range(model.get_piece_size())))
        ]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes))

    def both(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and B; none where either's bytes are not a space and the text."""
        none = np.empty(0, np.int64)
        if not text:
            return none, none
        a, b = self._a.encode_to_numpy(" " + text, disallowed_special=()), self._b.encode(text)
        whole = b" " + text.encode("utf-8", "surrogatepass")
        if b"".join(map(self.b_bytes.__getitem__, b)) != whole or b"".join(map(self.a_bytes.__getitem__, a.tolist())) != whole:
            return none, none
        return a.astype(np.int64), np.array(b, np.int64)


def groups_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of A and of B, numbered from left to right.

    ``a_ends`` and ``b_ends`` are the byte offsets where tokens of the same bytes end. Every token
    points to the token that overlaps it and reaches farthest right: one of A to one of B, and one
    of B to one of A that reaches beyond it, or else to itself. Successors are replaced by their own
    successors until nothing changes; all tokens of a group then point to its last one.
    """
    n = len(a_ends)
    after = np.empty(n + len(b_ends), np.int64)
    after[:n] = n + np.searchsorted(b_ends, a_ends)
    over = np.searchsorted(a_ends, b_ends)
    own = n + np.arange(len(b_ends))
    beyond = a_ends[over] > b_ends if n else np.zeros(0, bool)
    after[n:] = np.where(beyond, over, own)
    number = np.cumsum(~beyond) - 1
    while True:
        further = after[after]
        if np.array_equal(further, after):
            break
        after = further
    groups = number[after - n]
    return groups[:n], groups[n:]


def links_of(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``group, pair, times``: the id pairs that tokens of a group make, ``pair`` being A id * width + B id.

    A pair may come several times. Large groups are taken by their different ids, so that they cost what
    they give and not the product of their tokens.
    """
    n = int(in_b[-1]) + 1 if len(in_b) else 0
    many_a, many_b = np.bincount(in_a, minlength=n), np.bincount(in_b, minlength=n)
    from_a, from_b = np.cumsum(many_a) - many_a, np.cumsum(many_b) - many_b
    large = np.flatnonzero(many_a * many_b > LARGE_GROUP)
    each = many_b.copy()
    each[large] = 0
    repeat = each[in_a]
    place = np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat)
    group = np.repeat(in_a, repeat)
    pair = np.repeat(a, repeat) * width + b[from_b[group] + place]
    found = [(group, pair, np.ones(len(pair), np.int64))]
    for g in large.tolist():
        ids_a, n_a = np.unique(a[from_a[g] : from_a[g] + many_a[g]], return_counts=True)
        ids_b, n_b = np.unique(b[from_b[g] : from_b[g] + many_b[g]], return_counts=True)
        pairs = (ids_a[:, None] * width + ids_b).ravel()
        found.append((np.full(len(pairs), g), pairs, np.outer(n_a, n_b).ravel()))
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


class Aligner:
    """Rows of :func:`aligned` for blocks of texts."""

    def __init__(self, vocabularies: tuple[str, str, str]):
        self.tokenizers = Tokenizers(*vocabularies)
        self.width = len(self.tokenizers.b_bytes)
        # What an id looks like before another of its side, before the other side and before the next group.
        widest = max(len(self.tokenizers.a_bytes), self.width)
        self._written = [f"{i}{mark}" for mark in ",|;" for i in range(widest)]
        self._widest = widest

    def _text(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, ends: np.ndarray) -> list[str]:
        """The groups of each text, as ``a1,a2|b1;a3|b2``; a text's tokens end at ``ends``."""
        n = int(in_b[-1]) + 1 if len(in_b) else 0
        upto_a, upto_b = np.cumsum(np.bincount(in_a, minlength=n)), np.cumsum(np.bincount(in_b, minlength=n))
        last_a, last_b = (np.append(x[1:] != x[:-1], True)[: len(x)].astype(np.int64) for x in (in_a, in_b))
        codes = np.empty(len(a) + len(b), np.int64)
        before_b = np.concatenate([[0], upto_b])
        codes[np.arange(len(a)) + before_b[in_a]] = a + last_a * self._widest
        codes[np.arange(len(b)) + upto_a[in_b]] = b + 2 * last_b * self._widest
        starts = np.concatenate([[0], ends[:-1]])
        write = self._written.__getitem__
        return ["".join(map(write, codes[x:y].tolist()))[:-1] for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]

    def rows(self, block: int, ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        tokens = [self.tokenizers.both(text) for text in texts]
        sizes_a, sizes_b = (np.array([len(t[k]) for t in tokens], np.int64) for k in (0, 1))
        a, b = (np.concatenate([np.empty(0, np.int64), *(t[k] for t in tokens)]) for k in (0, 1))
        in_a, in_b = groups_of(np.cumsum(self.tokenizers.a_sizes[a]), np.cumsum(self.tokenizers.b_sizes[b]))
        doc_a = np.repeat(np.arange(len(texts)), sizes_a)
        n_groups = int(in_b[-1]) + 1 if len(in_b) else 0
        doc_of = np.zeros(n_groups, np.int64)
        doc_of[in_a] = doc_a
        group, pair, times = links_of(a, b, in_a, in_b, self.width)

        doc = doc_of[group]
        order = np.lexsort((pair, doc))
        doc, pair, times = doc[order], pair[order], times[order]
        new = np.append(len(pair) > 0, (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1]))[: len(pair)]
        starts = np.flatnonzero(new)
        times = np.add.reduceat(times, starts) if len(starts) else times
        doc, pair = doc[starts], pair[starts]
        different, places, in_docs = np.unique(pair, return_inverse=True, return_counts=True)

        n = len(texts)
        n_links = np.zeros(n, np.int64)
        np.add.at(n_links, doc, times)
        offsets = pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32())
        none = pa.nulls(n, pa.list_(pa.int64()))
        own = [
            pa.array(np.full(n, block)),
            ids,
            pa.array(sizes_a),
            pa.array(sizes_b),
            pa.array(np.bincount(doc_of, minlength=n)),
            pa.array(n_links),
            pa.array(self._text(a, b, in_a, in_b, np.cumsum(sizes_a + sizes_b)), pa.string()),
            pa.ListArray.from_arrays(offsets, pa.array(places, pa.int32())),
            pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
            none,
            none,
        ]
        shared = [pa.array([block]), *(pa.nulls(1, c.type) for c in own[1:9])]
        shared += [pa.array([(different // self.width << 32) + different % self.width], none.type), pa.array([in_docs], none.type)]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(own, shared, strict=True)], names=COLUMNS)


COLUMNS = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "places", "times", "links", "docs"]
SCHEMA = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, places array<int>, times array<long>, "
    "links array<long>, docs array<long>"
)


def aligned(docs: DataFrame, vocabularies: tuple[str, str, str] | None = None) -> DataFrame:
    """A row for every row of ``docs(doc_id, text)`` and one for each block of them.

    A document has its numbers of tokens, groups and links, its ``groups`` written as
    ``a1,a2|b1;a3|b2,b3``, and its different links: ``places`` in the block's list with the ``times`` each
    occurs. A block's row holds that list, ``links`` (A id * 2^32 + B id), and how many ``docs`` of it have each.
    """
    vocabularies = vocabularies or default_vocabularies()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = Aligner(vocabularies)
        block = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size >= BLOCK_BYTES:
                    yield align.rows(block, pa.array(ids, pa.int64()), texts)
                    block, ids, texts, size = block + 1, [], [], 0
        if ids:
            yield align.rows(block, pa.array(ids, pa.int64()), texts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def link_counts(rows: DataFrame) -> DataFrame:
    """``a, b, docs, best`` of every id pair that the stored rows of :func:`aligned` link: in how many documents,
    and whether no other B id is linked with this A id in more."""
    each = rows.where("links is not null").select(F.explode(F.arrays_zip("links", "docs")).alias("link")).select("link.*")
    counts = each.groupBy("links").agg(F.sum("docs").alias("docs"))
    a, b = F.shiftright("links", 32).cast("int"), F.col("links").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    # An A id meets each B id once at most.
    highest = F.max("docs").over(Window.partitionBy("a"))
    return counts.select(a.alias("a"), b.alias("b"), "docs", "links").withColumn("best", F.col("docs") == highest)


def with_counts(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The documents' rows of :func:`aligned`, stored, with ``n_best`` and ``count_sum`` by the ``counts`` of links.

    A block asks for each of its different links once, so that a link in most documents is looked up
    once a block, and gets the answers in the order of its list.
    """
    asked = rows.where("links is not null").select("block", F.posexplode("links").alias("place", "links"))
    answers = asked.join(counts.select("links", "docs", "best"), "links")
    answers = answers.select(F.col("block").alias("asker"), "place", "docs", "best")
    documents = rows.where("links is null").drop("links", "docs")
    plain = [c for c in documents.columns if c not in ("block", "places", "times")]
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema}

    def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(values)])[ends])

    def count(key: tuple, own: pa.Table, known: pa.Table) -> pa.Table:
        own = own.combine_chunks()
        docs, best = np.zeros(known.num_rows, np.int64), np.zeros(known.num_rows, bool)
        places = known["place"].to_numpy()
        docs[places], best[places] = known["docs"].to_numpy(), known["best"].to_numpy()
        lists, times = ([chunk for chunk in own[c].chunks] for c in ("places", "times"))
        place = np.concatenate([np.empty(0, np.int64), *(x.flatten().to_numpy() for x in lists)]).astype(np.int64)
        often = np.concatenate([np.empty(0, np.int64), *(x.flatten().to_numpy() for x in times)])
        ends = np.concatenate([[0], np.cumsum([len(x) for x in own["places"]])]).astype(np.int64)
        added = [pa.array(sums(often * best[place], ends)), pa.array(sums(often * docs[place], ends))]
        return pa.Table.from_arrays([*(own[c] for c in plain), *added], names=[*plain, "n_best", "count_sum"])

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in plain), "n_best long", "count_sum long"])
    return documents.groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(count, schema)

import hashlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import DOCUMENTS, odd_documents, row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plaudit.llm import alignment
from plaudit.llm.alignment import aligned, groups_of, link_counts, links_of, with_counts
from plaudit.sources.shared import saved

ODD = [
    row(800, "a  b\n\n c\t <|endoftext|> <s> </s> <unk> <0x0A> [INST]"),
    row(801, "▁mark"),
    row(802, "Ünï çødé 123, it's 漢字かな 🙂👍🏽 é\0x"),
    row(803, " \t\n"),
    row(804, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 30),
    row(805, "ab cd " * 700),
    row(None, "ab cd"),
    row(806, "x=" + "/" * 500 + "0123456789" * 60 + "\r\n" * 90),
]


def tokens_of():
    """Ids with their bytes, straight from the libraries that the contract names."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in kept)}
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def piece(i):
        text = b.id_to_piece(i)
        return bytes([int(text[3:5], 16)]) if b.is_byte(i) else text.replace("▁", " ").encode()

    def both(text):
        if not text:
            return [], []
        ours = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        theirs = [(i, piece(i)) for i in b.encode(text)]
        whole = (" " + text).encode()
        return (ours, theirs) if b"".join(x for _, x in ours) == whole == b"".join(x for _, x in theirs) else ([], [])

    return both


def brute(rows):
    both, docs = tokens_of(), []
    for r in rows:
        a, b = both(r[1])
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in cuts]
        for k, side in enumerate((a, b)):
            at = 0
            for (token, _), end in zip(side, ends[k], strict=True):
                while cuts[at] < end:
                    at += 1
                groups[at][k].append(token)
        docs.append((r[0], len(a), len(b), groups))
    count, best = defaultdict(int), defaultdict(int)
    for *_, groups in docs:
        for pair in {(x, y) for xs, ys in groups for x in set(xs) for y in set(ys)}:
            count[pair] += 1
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, n_a, n_b, groups in docs:
        found = [count[x, y] == best[x] for xs, ys in groups for x in xs for y in ys]
        total = sum(count[x, y] for xs, ys in groups for x in xs for y in ys)
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        out.append((doc_id, n_a, n_b, len(groups), len(found), digest, sum(found), total))
    return out


def check(spark, rows):
    found = aligned(spark.createDataFrame(rows, DOCUMENTS))
    found = saved(found.withColumn("groups", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))))
    result = with_counts(found, link_counts(found)).collect()
    assert sorted(map(tuple, result), key=repr) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("block", [500, 4 << 20])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    monkeypatch.setattr(alignment, "LARGE_GROUP", 3 if block == 500 else 4096)
    check(spark, odd_documents() + ODD)


def test_small_tables(spark):
    check(spark, [])
    check(spark, [row(1, None), row(2, "")])


def test_groups_end_where_both_tokens_end():
    rng = np.random.default_rng(3)
    for n in (1, 5, 40, 2000):
        ends = [np.unique(np.append(rng.integers(1, 3 * n, n), 3 * n)) for _ in range(2)]
        cuts = np.intersect1d(*ends)
        for mine, own in zip(groups_of(*ends), ends, strict=True):
            assert (mine == np.searchsorted(cuts, own)).all()
    # A chain over the whole text: A ends at odd offsets, B at even ones.
    a, b = groups_of(np.append(np.arange(1, 9999, 2), 10000), np.arange(2, 10001, 2))
    assert not a.any() and not b.any()
    assert [len(x) for x in groups_of(np.empty(0, int), np.empty(0, int))] == [0, 0]


def test_large_groups_cost_their_different_ids():
    a, b = np.zeros(50_000, int), np.ones(40_000, int)
    group, pair, times = links_of(a, b, a, b * 0, 100)
    assert (group.tolist(), pair.tolist(), times.tolist()) == ([0], [1], [50_000 * 40_000])

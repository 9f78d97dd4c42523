import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from helpers import DOCUMENTS, odd_documents, row, texts
from tokenizers import Tokenizer

from plaudit.llm.packing import Encoder, Plan, combinations, default_vocabulary, least_squares, packed


def ids_of(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_ids_are_the_tokenizers_own():
    encode = Encoder(*default_vocabulary())
    odd = ["", " ", "a  b\n\n c\t", "x<|endoftext|> y", "Ünï çødé 123 it's", "   a", "🙂👍🏽 汉字かな", "a" * 300, "\r\n \r\n"]
    for text in odd + texts(7, 3):
        assert encode.document(text) == ids_of(text).tobytes(), text


def test_least_squares_and_plan():
    rng = np.random.default_rng(1)
    histogram = np.zeros(256, np.int64)
    histogram[1:] = rng.integers(0, 40, 255)
    combos = combinations(histogram)
    assert (combos.sum(1) == 256).all()
    off = np.zeros(256)
    np.add.at(off, combos.ravel(), np.repeat(least_squares(combos, histogram), 3))
    assert np.abs(off[1:] - histogram[1:]).sum() < 0.2 * histogram.sum()
    plan, filled = Plan(histogram), defaultdict(list)
    for length in range(1, 256):
        for rank in range(histogram[length]):
            parts = plan.place(length, rank)
            assert sum(p[1] for p in parts) == length
            for _, n, sequence, offset in parts:
                filled[sequence].append((offset, n))
    for spans in filled.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at == 256 or at & (at - 1) == 0


def check(rows, found):
    """Every id in one piece, sequences without gaps, no padding."""
    left = defaultdict(list)
    for r in rows:
        left[r[0]].append(ids_of(r[1]))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc_id, all_ids in left.items():
        for ids in all_ids:
            same = [x for x in all_ids if len(x) == len(ids)]
            own = pieces[doc_id, len(ids)]
            assert sum(r.length for r in own) == len(ids) * len(same)
            for r in own:
                assert r.ids_crc32 in {zlib.crc32(x[r.start : r.start + r.length].tobytes()) for x in same}
    for spans in sequences.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at == 2048 or (at < 2048 and at & (at - 1) == 0)


def test_packed(spark):
    rows = odd_documents() + [row(500 + i, t) for i, t in enumerate(texts(8, 60, 150))]
    check(rows, packed(spark.createDataFrame(rows, DOCUMENTS)).collect())


def test_empty_table(spark):
    assert packed(spark.createDataFrame([], DOCUMENTS)).count() == 0

import hashlib
import zlib

from helpers import DOCUMENTS, odd_documents, row, texts
from hypothesis import given, settings, strategies as st

from plaudit.llm.sharding import Run, shard_by_bytes, smallest_capacity


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=25), st.integers(1, 6))
def test_smallest_capacity(sizes, shards):
    def needed(capacity):
        used, room = 0, 0
        for size in sizes:
            if size > room:
                used, room = used + 1, capacity
            room -= size
        return used

    least = next(c for c in range(max(sizes), sum(sizes) + 1) if needed(c) <= shards)
    runs = [Run(f"{i:03}", size, 1, size) for i, size in enumerate(sizes)]
    assert smallest_capacity(runs, shards, True) == least == smallest_capacity(runs, shards, False)


def check(rows, found, shards):
    assert len(found) == len(rows)
    text = {}
    for r in rows:
        text.setdefault(r[0], set()).add(r[1])
    of_text = {}
    for r in found:
        assert (r["size"], r.text_crc32) in {(len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in text[r.doc_id]}
        of_text.setdefault((r["size"], r.text_crc32), set()).add(r.shard)
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
    for shard in {r.shard for r in found}:
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(sum(r.shard == shard for r in found)))
    assert all(len(s) == 1 for (size, _), s in of_text.items() if size > 1)


def test_shards(spark):
    rows = odd_documents()
    check(rows, shard_by_bytes(spark.createDataFrame(rows, DOCUMENTS)).collect(), 16)


def test_near_equal_and_a_giant_alone(spark):
    rows = [row(i, t) for i, t in enumerate(texts(4, 900, 20))] + [row(1000 + i, "same text " * 20) for i in range(300)]
    found = shard_by_bytes(spark.createDataFrame(rows, DOCUMENTS)).collect()
    check(rows, found, 16)
    sizes = [sum(r["size"] for r in found if r.shard == s) for s in range(16)]
    giant = max(sizes)
    assert giant == 300 * 201 and max(sizes[1:]) <= 1.05 * sum(sizes[1:]) / 15


def test_cut_at_the_least_capacity(spark):
    """Plain greedy filling over all groups, capacity after capacity."""
    kinds = texts(14, 300, 15)
    rows = [row(i, kinds[i * i % 300][: 20 + i % 70]) for i in range(900)]
    groups = {}
    for r in rows:
        key = hashlib.md5(r[1].encode()).hexdigest()
        groups[key] = groups.get(key, 0) + len(r[1].encode()) + 1
    order = sorted(groups)

    def needed(capacity):
        used, room = 0, 0
        for key in order:
            if groups[key] > room:
                used, room = used + 1, capacity
            room -= groups[key]
        return used

    least = next(c for c in range(max(groups.values()), sum(groups.values())) if needed(c) <= 16)
    found = shard_by_bytes(spark.createDataFrame(rows, DOCUMENTS)).collect()
    check(rows, found, 16)
    of_doc = {r.doc_id: r.shard for r in found}
    assert max(sum(r["size"] for r in found if r.shard == s) for s in range(16)) == least
    shard_of = {hashlib.md5(r[1].encode()).hexdigest(): of_doc[r[0]] for r in rows}
    shards = [shard_of[key] for key in order]
    assert shards == sorted(shards)


def test_empty_table(spark):
    assert shard_by_bytes(spark.createDataFrame([], DOCUMENTS)).count() == 0

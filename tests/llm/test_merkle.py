import hashlib
import zlib

import pytest
from helpers import DOCUMENTS, odd_documents, row

from plaudit.llm.merkle import audited, height, manifest, proofs


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    fields = (doc_id, source, lang, n_chars, text)
    return digest(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def levels_over(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, i):
    found = []
    for level in levels[:-1]:
        run = level[i // 3 * 3 : i // 3 * 3 + 3]
        found.append((run[: i % 3], run[i % 3 + 1 :]))
        i //= 3
    return found


def brute(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append((r[0], leaf(*r), r))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by_source[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = levels_over([x[1] for x in by_source[s]])
    over = levels_over([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, (doc_id, own, r) in enumerate(by_source[s]):
            path = siblings(trees[s], i) + siblings(over, k)
            text = r[1]
            if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
                text = text.replace("\n", "")
            now = leaf(r[0], text, *r[2:])
            for left, right in path:
                now = digest(*left, now, *right)
            proof = digest(*[x for left, right in path for x in left + right])
            out.append((doc_id, own, trees[s][-1][0], over[-1][0], proof, now, now == over[-1][0]))
    return out


def check(spark, rows):
    found = audited(spark.createDataFrame(rows, DOCUMENTS)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(brute([r[:5] for r in rows]), key=repr)


# A source that outgrows what one shuffle builds, one with a run of one on some levels, lines to tamper
# with, nulls, ties, repeated rows, sources that end on different levels.
MANY = [row(i, f"line {i}\nmore\n", "hot") for i in range(800)] + [row(2000 + i, f"x\n{i}", f"s{i % 37}") for i in range(120)]


def test_against_brute_force(spark):
    check(spark, odd_documents() + MANY + [row(900, "a\nb", None), row(901, "\n", "é"), row(902, "", "~")])


@pytest.mark.parametrize("n", [0, 1, 4])
def test_small_tables(spark, n):
    check(spark, [row(i, f"{i}\n", "one") for i in range(n)])
    check(spark, [row(i, f"{i}\n", f"own{i}") for i in range(n)])


def test_proofs_hold_and_sizes_are_logarithmic(spark):
    shown = proofs(manifest(spark.createDataFrame(MANY, DOCUMENTS))).collect()
    assert len(shown) == len(MANY) and {len(r.path) for r in shown if r.doc_id < 800} == {height(800) + height(38)}
    for r in shown:
        now = r.leaf
        for at in r.path:
            now = digest(at.left, now, at.right)
        assert now == r.root


def test_a_hot_source_is_numbered_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr("plaudit.llm.merkle.ROWS_TOGETHER", 100)
    check(spark, MANY + odd_documents())

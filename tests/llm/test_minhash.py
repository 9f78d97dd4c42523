import pytest
from helpers import DOCUMENTS, near_copy, odd_documents, reach, row, shingles, texts

from plaudit.llm import common, minhash
from plaudit.llm.common import components
from plaudit.llm.minhash import near_duplicates


def brute(rows, words):
    sets = {}
    for doc_id, text, *_ in rows:
        sets.setdefault(doc_id if doc_id is not None else f"null {text}", shingles(text, words))

    def linked(x, y):
        both = len(sets[x] & sets[y])
        return both and 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both)

    named = [x for x in sets if not isinstance(x, str)]
    return sets, reach(named, linked)


@pytest.mark.parametrize("words", [2, 5])
def test_against_brute_force(spark, words):
    rows = odd_documents()
    sets, label = brute(rows, words)
    found = near_duplicates(spark.createDataFrame(rows, DOCUMENTS), words=words).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), label[r.doc_id])
            assert r.kept == (r.doc_id == r.component_id)
    unnamed = sorted(str(r.component_id) for r in found if r.doc_id is None)
    assert unnamed == ["7", "None"] and not any(r.kept for r in found if r.doc_id is None)


def test_large_buckets_in_small_blocks(spark, monkeypatch):
    """A crowd around 0.8, compared in blocks of a few rows, loses no link."""
    monkeypatch.setattr(minhash, "BLOCK", 7)
    base = texts(3, 1, 80)[0]
    rows = [row(i, near_copy(base, i, 2 + i % 7)) for i in range(60)]
    sets, label = brute(rows, 2)
    found = near_duplicates(spark.createDataFrame(rows, DOCUMENTS)).collect()
    assert {r.doc_id: r.component_id for r in found} == label
    assert len(set(label.values())) > 3


def test_empty_table(spark):
    found = near_duplicates(spark.createDataFrame([], DOCUMENTS))
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"] and found.count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 31), (32, 31), (31, 31), (None, 5), (40, 30)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(21), 0), **dict.fromkeys((30, 31, 32, 40), 30)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_stars_take_no_round(spark, monkeypatch):
    rounds = []
    large = common._large_star
    monkeypatch.setattr(common, "_large_star", lambda edges, rows: rounds.append(rows) or large(edges, rows))
    stars = spark.createDataFrame([(2, 1), (3, 1), (5, 4), (4, 5), (None, 7)], "a long, b long")
    assert {r.node: r.label for r in components(stars).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    assert not rounds
    path = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert {r.label for r in components(path).collect()} == {1} and len(rounds) == 1


def test_exploded_bands_are_not_broadcast(spark, monkeypatch):
    """They are estimated as if there was one band of each set, so a limit by size does not hold them back."""
    plans, kept = [], minhash.saved
    monkeypatch.setattr(minhash, "saved", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    near_duplicates(spark.createDataFrame(odd_documents(), DOCUMENTS))
    joins = [line for plan in plans for line in plan.splitlines() if "Join [bucket" in line]
    assert any("SortMergeJoin" in line for line in joins)

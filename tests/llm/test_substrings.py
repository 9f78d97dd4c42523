import random

import numpy as np
import pytest
from helpers import DOCUMENTS, odd_documents, row

from plaudit.llm import substrings
from plaudit.llm.substrings import COVERS, Distinct, cover_of, without_repeats


def brute(rows, window):
    least = {}
    words = [(r[1] or "").encode().split() for r in rows]
    for r, own in zip(rows, words, strict=True):
        if r[0] is not None:
            for i in range(len(own) - window + 1):
                key = tuple(own[i : i + window])
                least[key] = min(least.get(key, r[0]), r[0])
    out = []
    for r, own in zip(rows, words, strict=True):
        gone = set()
        if r[0] is not None:
            for i in range(len(own) - window + 1):
                if least[tuple(own[i : i + window])] < r[0]:
                    gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(own) if i not in gone).decode()
        out.append((r[0], len(own), len(gone), kept))
    return out


def planted():
    """Passages of every length around the window at every shift, in other documents and in their own."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: rng.choices(vocabulary, k=n)
    passages = [text(n) for n in (11, 12, 13, 14, 20, 27, 60)]
    rows = []
    for i in range(90):
        passage = passages[i % len(passages)]
        rows.append(row(1000 + i, " ".join(text(rng.randint(0, 30)) + passage + text(rng.randint(0, 9)))))
    common = " ".join(passages[4])
    rows += [row(2000 + i, f"{common}\n{common} {i}") for i in range(60)]
    rows += [row(2500, " ".join(["same"] * 40)), row(2501, " ".join(["same"] * 12)), row(2502, "\t".join(["same"] * 13)), row(2503, "Same " * 50)]
    rows += [row(2600, common), row(2600, common + " more"), row(None, common), row(-5, common)]
    return rows


def check(spark, rows, window=13):
    found = without_repeats(spark.createDataFrame(rows, DOCUMENTS), window).collect()
    assert sorted((tuple(r)[:4] for r in found), key=repr) == sorted(brute(rows, window), key=repr)
    for r in found:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed


def test_covers():
    for period, places in COVERS.items():
        differences = {(x - y) % period for x in places for y in places}
        assert differences == set(range(period))
    assert cover_of(13) == (7, (0, 1, 3), 7) and cover_of(50)[0] == 21 and cover_of(1)[0] == 1


def test_distinct():
    keys = np.array([5, 3, 5, 3, 9], np.uint64)
    own = Distinct(keys, np.array([1, 1, 1, 2, 0], np.uint32))
    assert keys[own.first].tolist() == [3, 3, 5, 9] and own.number.tolist() == [2, 0, 2, 1, 3] and own.last.tolist() == [1, 3, 2, 4]
    assert len(Distinct(np.empty(0, np.uint64)).first) == 0


@pytest.mark.parametrize("block", [300, 4 << 20])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", block)
    monkeypatch.setattr(substrings, "CELL_PRINTS", 50 if block == 300 else 1 << 20)
    check(spark, odd_documents() + planted())


def test_other_windows_and_small_tables(spark):
    check(spark, planted()[:40], 5)
    check(spark, [])
    check(spark, [row(1, None), row(2, "")])


def test_texts_are_dealt_once(spark):
    """All steps read one exchange of the texts."""
    result = without_repeats(spark.createDataFrame(planted(), DOCUMENTS))
    result.collect()
    plan = result._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert sum("REPARTITION_BY_NUM" in line and "Reused" not in line for line in plan.splitlines()) == 1

import numpy as np

from plaudit.llm import hilbert
from plaudit.llm.hilbert import hilbert_keys, nearest

SCHEMA = "vec_id long, embedding array<float>, label int, spot string, rank string"


def brute(rows, every, k):
    good = {}
    for vec_id, v, *_ in rows:
        if vec_id is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault(vec_id, []).append(np.array(v, np.float32).astype(float))
    cosine = lambda x, y: x @ y / (np.linalg.norm(x) * np.linalg.norm(y))
    out = {}
    for q in (i for i in good if i % every == 0):
        best = []
        for i, vectors in good.items():
            scores = [cosine(x, y) for x in good[q] for y in vectors if len(x) == len(y)]
            if i != q and scores:
                best.append((-round(max(scores), 9), i))
        out[q] = [i for _, i in sorted(best)[:k]]
    return out


def test_curve_visits_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def odd_vectors():
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(20)] + [(10, rows[10][1]), (None, rows[1][1]), (400, None), (410, [0.0] * 8)]
    rows += [(420, [float("nan")] * 8), (430, [None] * 8), (440, [1.0, 2.0]), (441, [1.0, 2.5]), (450, []), (460, [5.0])]
    return [(*r, 1, "clash", "clash") for r in rows]


def test_one_run_is_exact(spark):
    rows = odd_vectors()
    found = nearest(spark.createDataFrame(rows, SCHEMA), every=10).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(got.setdefault(r.query_id, [])) + 1
        got[r.query_id].append(r.vec_id)
    assert got == {q: ids for q, ids in brute(rows, 10, 5).items() if ids}


def test_recall_over_many_runs(spark, monkeypatch):
    monkeypatch.setattr(hilbert, "RUN", 100)
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(64).astype(np.float32).tolist(), 1, "", "") for i in range(3000)]
    want = brute(rows, 50, 5)
    found = nearest(spark.createDataFrame(rows, SCHEMA)).collect()
    hits = sum(r.vec_id in want[r.query_id] for r in found)
    assert len(found) == 5 * len(want) and hits >= 0.9 * len(found)


def test_empty_table(spark):
    found = nearest(spark.createDataFrame([], SCHEMA))
    assert found.columns == ["query_id", "rank", "vec_id", "score"] and found.count() == 0

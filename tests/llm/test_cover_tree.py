import numpy as np
import pytest
from helpers import reach

from plaudit.llm import cover_tree
from plaudit.llm.cover_tree import Tree, compare, threshold_links

SCHEMA = "vec_id long, embedding array<float>, label int, node string, vector string"


def odd_vectors():
    rng = np.random.default_rng(5)
    rows = []
    for centre in range(12):
        base = rng.standard_normal(16)
        for i in range(rng.integers(1, 14)):
            vector = base + rng.standard_normal(16) * rng.choice([0.0, 0.1, 0.25, 0.4])
            rows.append((len(rows), vector.astype(np.float32).tolist(), int(centre % 3)))
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] + [1.0] * 15, 1), (1003, [None] + [1.0] * 15, 1)]
    rows += [(1004, [float("inf")] * 16, 1), (1005, rows[0][1], None), (1006, [1.0, 0.0], 0), (1007, [2.0, 0.0], 0), (1008, [], 0)]
    rows += [(1009, [2 * x for x in rows[0][1]], rows[0][2]), (1010, rows[0][1], rows[0][2]), (None, rows[0][1], rows[0][2]), (3, rows[3][1], rows[3][2])]
    return [(*r, "clash", "clash") for r in rows]


def brute(rows):
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, np.float32).astype(float)
        return v / np.linalg.norm(v)

    vectors = [unit(r[1]) for r in rows]

    def linked(i, j):
        one, two = vectors[i], vectors[j]
        alike = rows[i][2] is not None and rows[i][2] == rows[j][2] and one is not None and two is not None
        return alike and len(one) == len(two) and one @ two >= 0.93

    n = [sum(linked(i, j) for j in range(len(rows)) if i != j) for i in range(len(rows))]
    label = reach(range(len(rows)), linked)
    members = {}
    for i, root in label.items():
        members.setdefault(root, []).append(rows[i][0])
    return sorted(
        (str(rows[i][0]), n[i], str(min((x for x in members[label[i]] if x is not None), default=None))) for i in range(len(rows))
    )


@pytest.mark.parametrize("block", [2048, 5])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    rows = odd_vectors()
    found = threshold_links(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in found) == brute(rows)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in found)


def test_empty_table(spark):
    assert threshold_links(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tree_covers(monkeypatch):
    monkeypatch.setattr(cover_tree, "LEAF", 3)
    rng = np.random.default_rng(2)
    rows = np.repeat(rng.standard_normal((60, 5)), 3, 0) + rng.standard_normal((180, 5)) * 0.05
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    tree = Tree(rows)
    for node, children in enumerate(tree.children):
        apart = np.linalg.norm(rows[tree.members[node]] - tree.centres[node], axis=1)
        assert apart.max() <= tree.radii[node] + 1e-6
        if len(children):
            assert sorted(np.concatenate([tree.members[c] for c in children])) == sorted(tree.members[node])
            assert tree.centre[children[0]] == tree.centre[node]
            assert tree.radii[children].max() <= tree.radii[node] / 2 + 1e-6
    (counts, _), forest = compare(rows, None, (np.ones(180, int),) * 2, 0.93)
    near = rows @ rows.T >= 0.93
    assert (counts == near.sum(1) - 1).all()
    label = reach(range(180), lambda i, j: near[i, j])
    assert len({forest.find(i) for i in range(180)}) == len(set(label.values()))

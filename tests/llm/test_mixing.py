from collections import defaultdict

from helpers import DOCUMENTS, WORD, odd_documents, row, texts

from plaudit.llm.mixing import mixed


def targets(sizes):
    """Plain rounds of resharing the excess."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), list(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def check(rows, found):
    assert len(found) == len(rows)
    words = defaultdict(set)
    sizes, source_of = defaultdict(int), {}
    for r in rows:
        n = len(WORD.findall(r[1] or ""))
        words[r[0]].add(n)
        sizes[r[3]] += n
        source_of[r[0], n] = r[3]
    want, taken, largest = targets(sizes), defaultdict(int), defaultdict(int)
    for r in found:
        source = source_of[r.doc_id, r["size"]]
        assert r["size"] in words[r.doc_id] and r.source_size == sizes[source]
        assert abs(r.target - want[source]) < 1e-6 * (1 + want[source])
        assert r.taken <= 3 * r["size"] and (r["size"] == 0) <= (r.taken == 0)
        taken[source] += r.taken
    return want, taken


def test_mix(spark):
    rows = odd_documents()
    df = spark.createDataFrame(rows, DOCUMENTS)
    found = mixed(df).collect()
    check(rows, found)
    assert sorted(map(str, found)) == sorted(map(str, mixed(df.repartition(5)).collect()))


def test_targets_are_met(spark):
    rows = [row(i, t, f"s{i % 5}" if i % 3 else "hot") for i, t in enumerate(texts(5, 900, 30))]
    rows += [row(2000 + i, t, None) for i, t in enumerate(texts(6, 50, 7))]
    want, taken = check(rows, mixed(spark.createDataFrame(rows, DOCUMENTS)).collect())
    for source, target in want.items():
        assert 0 <= target - taken[source] <= 30, source


def test_documents_behind_a_long_one_are_drawn(spark):
    # Beside whole copies "a" takes 17,143 words more, into which its 20,000 words do not fit.
    rows = [row(i, t) for i, t in enumerate(texts(7, 200, 100))] + [row(900, " ".join(texts(8, 1, 20_000)))]
    rows += [row(2000 + i, t, "b") for i, t in enumerate(texts(9, 200, 100))]
    rows += [row(3000, " ".join(texts(10, 1, 20_000)), "b")]
    found = mixed(spark.createDataFrame(rows, DOCUMENTS)).collect()
    want, taken = check(rows, found)
    for source, target in want.items():
        gap = target - taken[source]
        ours = [r for r in found if r.source_key == "0" + source]
        fewest = min(r.copies for r in ours)
        assert gap >= 0 and not [r for r in ours if r.copies == fewest and r["size"] <= gap], source
        assert gap < 100, source


def test_empty_table_and_wordless_rows(spark):
    assert mixed(spark.createDataFrame([], DOCUMENTS)).count() == 0
    found = mixed(spark.createDataFrame([row(1, None), row(2, " ")], DOCUMENTS)).collect()
    assert [(r["size"], r.taken, r.target) for r in found] == [(0, 0, 0.0)] * 2

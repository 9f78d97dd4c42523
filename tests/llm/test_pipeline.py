from collections import Counter

import corpus_pipeline
from helpers import DOCUMENTS, near_copy, reach, row, shingles, texts
from test_packing import check

from plaudit.llm.toxicity import scored, train


def corpus():
    base = texts(12, 240, 30)
    rows = [row(i, t + (" scumbag blockhead" if i % 5 == 0 else ""), f"s{i % 4}") for i, t in enumerate(base)]
    rows += [row(1000 + i, near_copy(base[1 + i % 3], i, 1), "s1") for i in range(20)] + [row(2000, None, None), row(2001, ""), row(None, "nobody here"), rows[7]]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(240)]
    return rows, labels


def test_stages_against_plain_ones(spark, tmp_path):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, DOCUMENTS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)

    clean = stage["toxicity"](spark, docs, str(tmp_path)).collect()
    kept = Counter(r.doc_id for r in clean)
    assert kept == Counter(r[0] for r in rows if r[0] is None or r[0] >= 240 or r[0] % 5)

    clean_df = spark.createDataFrame(clean, DOCUMENTS)
    once = stage["near_duplicates"](spark, clean_df, str(tmp_path)).collect()
    named = {r.doc_id: r.text for r in clean if r.doc_id is not None}
    sets = {i: shingles(t, 5) for i, t in named.items()}
    near = lambda x, y: (b := len(sets[x] & sets[y])) and 100 * b >= 80 * (len(sets[x]) + len(sets[y]) - b)
    assert sorted(r.doc_id for r in once if r.doc_id is not None) == sorted(set(reach(sets, near).values()))
    assert sum(r.doc_id is None for r in once) == 1

    once_df = spark.createDataFrame(once, DOCUMENTS)
    mix = stage["mixing"](spark, once_df, str(tmp_path))
    assert mix.dtypes == docs.dtypes
    mix = mix.collect()
    source = {r.doc_id: r.source for r in once}
    assert all(source[r.doc_id] == r.source for r in mix) and max(Counter(r.doc_id for r in mix).values()) <= 3
    # The small source "a" comes first, so s0 to s3 weigh 2, 1, 5, 2.
    taken = Counter(r.source for r in mix)
    assert taken["s2"] > taken["s0"] > taken["s1"] > 0

    mix_rows = [tuple(r) for r in mix]
    check(mix_rows, stage["packing"](spark, spark.createDataFrame(mix_rows, DOCUMENTS), str(tmp_path)).collect())
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.length for r in whole) == sum(r.doc_tokens for r in whole if r.start == 0)
    assert Counter(r.doc_id for r in whole if r.start == 0) == Counter(r.doc_id for r in mix)


def test_unlike_rows_of_one_doc_id_stay(spark, tmp_path):
    a, b = texts(40, 2, 60)
    rows = [row(0, near_copy(a, 1, 1)), row(1, a), row(1, b), row(1, b), row(None, None, "s"), row(None, None, "t"), row(None, "", "u"), row(3, " ")]
    rows += [row(None, near_copy(b, 2, 1)), row(None, "only one")]
    found = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, spark.createDataFrame(rows, DOCUMENTS), str(tmp_path)).collect()
    want = [rows[0], rows[2], *rows[4:8], rows[9]]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))


def test_empty_stages(spark, tmp_path):
    docs = spark.createDataFrame([], DOCUMENTS)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0
        assert name == "packing" or out.dtypes == docs.dtypes


def test_score_column_of_any_name(spark):
    docs = spark.createDataFrame([row(1, "x")], DOCUMENTS)
    assert scored(docs, train(docs, spark.createDataFrame([], "doc_id long, toxic int")), "s").columns[-1] == "s"

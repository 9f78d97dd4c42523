"""Sinks and whole jobs, written and read back."""

import csv
import os
import subprocess
import sys
from pathlib import Path

import pytest
from fixtures import MICRO, frame
from pyspark.sql import functions as F

import plaudit as p
from plaudit.sources.shared import drop_saved, saved, shared_dir
from plaudit.sources.tables import review_stanzas

MEANS = {("A", "4.6"), ("B", "3.0"), ("C", "1.6666666666666667"), ("D", "4.0"), ("E", "2.0")}


def lines(path):
    return {tuple(row) for part in Path(path).glob("part-*") for row in csv.reader(part.open())}


@pytest.fixture(scope="module")
def scores(spark):
    return p.item_score(frame(spark, MICRO).repartition(4))


@pytest.fixture
def stanzas(tmp_path):
    records = [
        f"product/productId: {i}\nreview/userId: {u}\nreview/helpfulness: {up}/{total}\n"
        f"review/score: {s}.0\nreview/time: {t}\nreview/text: {'x' * n}"
        for i, u, s, up, total, t, n in MICRO
    ]
    path = tmp_path / "reviews.txt"
    path.write_text("\n\n".join(records))
    return str(path)


@pytest.mark.parametrize("rows", [2, 200_000])
def test_quoted_csv_is_written_alike_at_any_size(spark, tmp_path, rows):
    out = str(tmp_path / "quoted")
    p.write_quoted_csv(spark.range(0, rows, 1, 3).selectExpr("id", "id / 4 as quarter"), out)
    parts = sorted(Path(out).glob("part-*"))
    assert len(parts) == 3
    text = "".join(f.read_text() for f in parts)
    assert text.startswith('"0","0.0"\n"1","0.25"\n') and text.count("\n") == rows


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_parts_replace_older_output(spark, scores, tmp_path, fmt):
    out = str(tmp_path / fmt)
    p.write_parts(scores.union(scores), out, fmt)
    p.write_parts(scores, out, fmt)
    back = spark.read.schema("item_id string, mean_score double").format(fmt).load(out)
    assert {(r.item_id, str(r.mean_score)) for r in back.collect()} == MEANS
    assert back.count() == 5


def test_none_keeps_nothing(scores):
    p.write_none(scores)


def test_every_analysis_runs_as_a_job(spark, stanzas, tmp_path):
    rows = {name: p.run_job(spark, stanzas, name, "none") for name in p.ANALYSES}
    assert rows == {
        "pagerank_averageI": 5, "pagerank_average": 5, "pagerank_naive": 5, "pagerank_medium": 5,
        "pagerank_optimized": 5, "usersuggestion_naive": 11, "usersuggestion_improved": 10,
        "usersuggestion_optimized": 11, "filmdatescore": 11, "filmdatescore_aggregated": 7,
        "filmscore": 5, "lengthhelpfulness": 4, "userscore": 5, "userhelpfulness": 5,
    }


def test_no_reviews(spark, tmp_path):
    path = tmp_path / "empty.txt"
    path.write_text("\n\n\n")
    for name in p.ANALYSES:
        assert p.run_job(spark, str(path), name, "none") == 0


def test_job_saves_where_told(spark, stanzas, tmp_path):
    for save in ("local", "distributed", "s3"):
        out = str(tmp_path / save)
        assert p.run_job(spark, stanzas, "filmscore", save, out=out) == 5
        assert lines(out) == MEANS


def test_job_keeps_the_order_of_length_classes(spark, stanzas, tmp_path):
    out = str(tmp_path / "lengths")
    p.run_job(spark, stanzas, "lengthhelpfulness", out=out)
    parts = sorted(Path(out).glob("part-*"))
    assert [row[0] for part in parts for row in csv.reader(part.open())] == ["< 0", "< 1024", "< 2048", "< 4096"]


def test_job_filters_one_item(spark, stanzas, tmp_path):
    out = str(tmp_path / "one")
    p.run_job(spark, stanzas, "filmdatescore", "local", "B", out=out)
    assert lines(out) == {("B", "1970", "3.0"), ("B", "2008", "3.0"), ("B", "2009", "3.0")}


def test_command_line(stanzas, tmp_path):
    out = str(tmp_path / "cli")
    root = Path(__file__).resolve().parents[1]
    command = [sys.executable, "-m", "plaudit.plans.job", stanzas, "filmscore", "--out", out]
    env = {**os.environ, "PYTHONPATH": str(root), "PYSPARK_SUBMIT_ARGS": "--conf spark.ui.enabled=false pyspark-shell"}
    subprocess.run(command, check=True, env=env, cwd=tmp_path, timeout=120, capture_output=True)
    assert lines(out) == MEANS


def test_bad_requests(spark, stanzas):
    with pytest.raises(ValueError, match="unknown analysis"):
        p.run_job(spark, stanzas, "bestfilm")
    with pytest.raises(ValueError, match="output path"):
        p.run_job(spark, stanzas, "filmscore", "s3")


def test_stored_tables_need_their_columns(spark, tmp_path):
    path = str(tmp_path / "thin")
    frame(spark, MICRO).drop("body_length").withColumn("score", F.col("score").cast("float")).write.parquet(path)
    assert p.run_job(spark, path, "userhelpfulness", "none", source="parquet") == 5
    for analysis, column in (("lengthhelpfulness", "body_length"), ("filmscore", "score")):
        with pytest.raises(ValueError, match=column):
            p.run_job(spark, path, analysis, "none", source="parquet")
    with pytest.raises(ValueError, match="summary"):
        p.load_reviews(spark, path, "parquet")


def test_a_job_leaves_other_frames_alone(spark, stanzas):
    mine = saved(spark.range(3))
    before = set(Path(shared_dir(spark)).rglob("*"))
    p.run_job(spark, stanzas, "pagerank_optimized", "none")
    assert mine.count() == 3 and set(Path(shared_dir(spark)).rglob("*")) == before


def test_saved_tables_live_in_the_shared_folder_and_can_be_dropped(spark):
    df = saved(spark.range(10))
    folder = Path(shared_dir(spark))
    assert df.count() == 10 and any(str(folder) in f for f in df.inputFiles())
    drop_saved(spark)
    assert not list(folder.glob("plaudit-*"))


def test_records_of_a_named_job_are_stored_compressed(spark, monkeypatch):
    import __spark_entry__ as entry

    reviews = frame(spark, MICRO).withColumn("helpfulness", F.concat_ws("/", "up_votes", "total_votes"))
    monkeypatch.setattr(entry, "_records", lambda name: lambda spark, folder: review_stanzas(reviews))
    rows = {(r.item_id, str(r.mean_score)) for r in entry.queries()["job_filmscore"](spark, "").collect()}
    stored = list(Path(shared_dir(spark)).rglob("stanzas-*/part-*"))
    assert rows == MEANS and stored and all(path.name.endswith(".gz") for path in stored)

"""Text records, typing, and stored review tables."""

import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import plaudit as p
from plaudit.schema import REVIEW_SCHEMA
from plaudit.sources import shared

FULL = """product/productId: B1
review/userId: U1
review/profileName: Ann
review/helpfulness: 7/9
review/score: 3.0
review/time: 1041379200
review/summary: A: b :c
review/text: hi http://x.y/z"""


def parse(spark, text, tmp_path, **options):
    path = tmp_path / "reviews.txt"
    path.write_text(text, newline="")
    return [row.asDict() for row in p.load_reviews(spark, str(path), **options).collect()]


def one(spark, text, tmp_path, **options):
    (row,) = parse(spark, text, tmp_path, **options)
    return row


def test_full_record(spark, tmp_path):
    assert one(spark, FULL, tmp_path) == {
        "item_id": "B1",
        "user_id": "U1",
        "profile_name": "Ann",
        "helpfulness": "7/9",
        "score": 3.0,
        "review_time": 1041379200,
        "summary": "Abc",
        "body": "hi http//x.y/z",
        "up_votes": 7,
        "total_votes": 9,
        "down_votes": 2,
        "helpful_pct": 77,
        "body_length": 14,
    }


def test_schema_is_the_declared_one(spark, tmp_path):
    path = tmp_path / "r.txt"
    path.write_text(FULL)
    got = p.load_reviews(spark, str(path)).schema
    assert [(f.name, f.dataType) for f in got] == [(f.name, f.dataType) for f in REVIEW_SCHEMA]


def test_missing_fields_take_defaults(spark, tmp_path):
    row = one(spark, "product/productId: B1", tmp_path)
    assert (row["user_id"], row["helpfulness"], row["score"], row["review_time"]) == ("", "0/0", 0.0, 0)
    assert row["helpful_pct"] is None and row["body_length"] == 0


@pytest.mark.parametrize(
    "line,field,want",
    [
        ("review/summary: a\nreview/summary: b", "summary", "b"),
        ("any/summary: x", "summary", "x"),
        ("summary: x", "summary", ""),
        ("review/text:", "body", ""),
        ("review/text", "body", ""),
        ("review/summary: a\nreview/summary", "summary", ""),
        ("a/b", "summary", ""),
        ("review/summary/more: x", "summary", "x"),
        ("review/summary : x", "summary", ""),
        ("review/text: \t a b \x01\x1f", "body", "a b"),
        ("review/text: a: : b ::", "body", "ab"),
        ("review/text: a\u00a0", "body", "a\u00a0"),
        ("review/text: see x/summary: no", "summary", ""),
        ("review/text: x\r", "body", "x"),
        ("::\n/\n:/summary: q", "summary", ""),
    ],
)
def test_line_grammar(spark, tmp_path, line, field, want):
    assert one(spark, "product/productId: B1\n" + line, tmp_path)[field] == want


def test_blank_records(spark, tmp_path):
    text = FULL + "\n\n\n\n" + FULL + "\n\n\n" + FULL + "\n"
    assert [r["item_id"] for r in parse(spark, text, tmp_path)] == ["B1"] * 3
    kept = parse(spark, text, tmp_path, keep_blank=True)
    assert sorted(r["item_id"] for r in kept) == ["", "B1", "B1", "B1"]


def test_percentage_truncates_and_is_not_clamped(spark, tmp_path):
    text = "\n\n".join(f"review/userId: u{k}\nreview/helpfulness: {h}" for k, h in enumerate(["2/3", "5/2", "3/0"]))
    rows = {r["user_id"]: r["helpful_pct"] for r in parse(spark, text, tmp_path)}
    assert rows == {"u0": 66, "u1": 250, "u2": None}


def test_length_counts_utf16_units(spark, tmp_path):
    assert one(spark, "review/text: a\U0001f600", tmp_path)["body_length"] == 3


@pytest.mark.parametrize("bad", ["helpfulness: x", "helpfulness: 7", "score: high", "time: 1.5x"])
def test_malformed_numbers(spark, tmp_path, bad):
    with pytest.raises(PySparkException):
        parse(spark, f"review/{bad}", tmp_path)
    row = one(spark, f"review/{bad}", tmp_path, mode="permissive")
    assert row["user_id"] == "" and None in (row["score"], row["review_time"], row["total_votes"])


def test_records_across_splits_are_read_once(spark, tmp_path):
    stanzas = [f"product/productId: B{k}\nreview/text: {'x' * (k % 97)}" for k in range(3000)]
    path = tmp_path / "many.txt"
    path.write_text("\n\n".join(stanzas))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        reviews = p.load_reviews(spark, str(tmp_path / "*.txt"))
        assert reviews.rdd.getNumPartitions() > 10
        got = {r.item_id: r.body_length for r in reviews.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {f"B{k}": k % 97 for k in range(3000)}


def test_stored_table_reads_narrow_columns(spark, tmp_path):
    text, table = tmp_path / "r.txt", str(tmp_path / "table")
    text.write_text(FULL)
    p.load_reviews(spark, str(text)).write.parquet(table)
    reviews = p.load_reviews(spark, table, source="parquet")
    assert reviews.count() == 1
    plan = p.item_score(reviews)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<item_id:string,score:double>" in plan
    one_item = p.item_year_score(reviews, "B1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(item_id,B1)" in one_item


def test_preview(spark, tmp_path):
    path = tmp_path / "r.txt"
    path.write_text("review/text: " + "ab" * 100)
    (row,) = p.review_preview(p.load_reviews(spark, str(path))).collect()
    assert row.preview == "ab" * 64 + "..."


def test_unknown_options(spark):
    with pytest.raises(ValueError):
        p.load_reviews(spark, "x", source="avro")
    with pytest.raises(ValueError):
        p.to_reviews(spark.range(1), mode="lenient")


def test_lines_of_other_fields_are_not_taken_apart(spark, tmp_path):
    path = tmp_path / "r.txt"
    path.write_text(FULL)
    fields = p.parse_stanzas(p.read_stanzas(spark, str(path))).select("userId")
    plan = fields._jdf.queryExecution().optimizedPlan().toString()
    assert "named_struct" not in plan and "productId" not in plan
    assert fields.first()[0] == "U1"


def test_values_with_several_colons_and_lines_without_a_value(spark, tmp_path):
    text = "a/userId/x/y: 1:: 2 :\t3 \nb/userIdx: no\nc:d/userId: no\nreview/summary:\nreview/text"
    row = one(spark, text, tmp_path)
    assert (row["user_id"], row["summary"], row["body"]) == ("123", "", "")


def test_shuffle_files_go_with_the_query_that_saves(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {name for name in str(blocks.getAllFiles().mkString("\n")).split("\n") if "/shuffle_" in name}

    before, was = files(), spark.conf.get(shared.CLEANUP)
    rows = shared.saved(spark.range(1000).repartition(7).groupBy((F.col("id") % 10).alias("k")).count())
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before
    assert rows.count() == 10 and spark.conf.get(shared.CLEANUP) == was

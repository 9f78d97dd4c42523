"""Hot keys are dealt over several tasks, and what cannot matter is not made."""

import random
import re
from pathlib import Path
from statistics import median

import pytest
from fixtures import Brute, frame
from pyspark.sql import functions as F

import plaudit as p
from plaudit.operators import agreement, skew
from plaudit.operators.agreement import asked_sides, class_pairs, numbers_of, open_ledger, users_of_classes
from plaudit.operators.consensus import graded_reviews
from plaudit.operators.skew import counts_of, hot_keys, in_pieces, split_join
from plaudit.sources.shared import shared_dir


def lopsided(n=30_000):
    """A third of the rows on one item, all with one score."""
    rng = random.Random(8)
    rows = []
    for k in range(n):
        item, score = ("hot", 5) if k % 3 == 0 else (f"i{rng.randrange(4000)}", rng.randint(1, 5))
        rows.append((item, f"u{rng.randrange(5000)}", score, 1, 2, k, 0))
    return rows


@pytest.fixture
def as_planned(spark):
    """Eight partitions that stay as they are planned."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    spark.conf.unset("spark.sql.adaptive.enabled")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def sizes(df):
    found = df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"))
    return sorted(r.n for r in found.collect())


def test_a_hot_score_of_an_item_is_dealt_over_tasks(spark, as_planned, monkeypatch):
    monkeypatch.setattr(skew, "LEAST_ROWS", 64)
    reviews = frame(spark, lopsided())
    graded = graded_reviews(reviews)
    assert graded.count() == 30_000
    tasks = sizes(graded)
    assert len(tasks) == 8 and tasks[-1] <= 2 * median(tasks)
    plain = reviews.join(p.helpfulness_by_score(reviews), ["item_id", "score"])
    assert sizes(plain)[-1] > 2 * median(sizes(plain))


def test_hot_keys_are_few(spark, as_planned, monkeypatch):
    monkeypatch.setattr(skew, "LEAST_ROWS", 1)
    counts = spark.range(1000).select("id", F.when(F.col("id") % 50 == 0, 10_000 + F.col("id")).otherwise(3).alias("n"))
    hot = hot_keys(counts)
    assert 0 < hot.count() <= 4 * 8
    assert hot_keys(counts.limit(0)).count() == 0


@pytest.mark.parametrize("both", [False, True])
def test_split_join_is_a_join(spark, as_planned, monkeypatch, both):
    monkeypatch.setattr(skew, "LEAST_ROWS", 5)
    left = spark.range(900).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 40).alias("k"), F.col("id").alias("x"))
    right = spark.range(300 if both else 50).select((F.col("id") if not both else F.col("id") % 7 * (F.col("id") % 2)).alias("k"), F.col("id").alias("y"))
    more = (hot_keys(counts_of(right, ["k"])), ["y"]) if both else ()
    got = split_join(left, right, ["k"], hot_keys(counts_of(left, ["k"])), ["x"], *more)
    want = left.join(right, "k")
    assert sorted(map(tuple, got.select("k", "x", "y").collect())) == sorted(map(tuple, want.select("k", "x", "y").collect()))
    assert sizes(got)[-1] < sizes(want)[-1]


def test_scores_of_one_item_are_not_shuffled(spark, as_planned):
    lifted = p.consensus_lift(frame(spark, lopsided(3000)), "hot")
    plan = lifted._jdf.queryExecution().executedPlan().toString()
    # The means themselves are summed per score; reviews do not meet on it.
    assert "MergeJoin [score" not in plan and "NestedLoop" not in plan and "hashpartitioning(score" not in plan
    assert lifted.count() == 1000


def crowded(spark, n=600):
    rng = random.Random(2)
    rows = []
    for k in range(n):
        for item in rng.sample(["h0", "h1", "h2"], rng.randint(1, 3)):
            rows.append((item, f"u{k}", rng.randint(1, 5), 1, 2, k, 0))
        rows.append((f"i{rng.randrange(200)}", f"u{k}", rng.randint(1, 5), 1, 2, k, 0))
    return open_ledger(frame(spark, rows), hot_least=100, hot_count=3)


def test_only_pairs_of_classes_that_agree_are_made(spark):
    crowd = crowded(spark).crowd
    columns = ["class_1", "class_2", "hot_gap", "hot_n", "hot_overlap"]
    every, close = class_pairs(crowd, 0.9), class_pairs(crowd, 0.0)
    want = every.filter("hot_gap = 0").select(columns).collect()
    assert sorted(map(tuple, close.select(columns).collect())) == sorted(map(tuple, want))
    assert 0 < len(want) < every.count() / 3


def test_some_users_read_their_items_and_classes_only(spark):
    ledger = crowded(spark)
    read, pairs = [], []
    for users in (1, 10, 100, 600):
        some = ledger.users.orderBy("user_id").limit(users).select("user_id")
        chosen = numbers_of(ledger, some)
        read.append(asked_sides(ledger, chosen)[1].count())
        pairs.append(class_pairs(ledger.crowd, 0.0, chosen).count())
    assert read == sorted(read) and read[0] * 20 < read[1] * 5 < read[3] == ledger.second.count()
    assert pairs == sorted(pairs) and pairs[0] < pairs[1] < pairs[3]


def test_classes_become_pairs_of_users_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(agreement, "MEMBER_BLOCK", 10)
    members = spark.range(200).select(F.col("id").alias("uid"), F.when(F.col("id") < 150, 7).otherwise(F.col("id") % 4).alias("class_id"))
    lists, hot = agreement._blocks(members)
    assert max(len(r.uids) for r in lists.collect()) < 30 and {r.class_id for r in hot.collect()} >= {7}
    close = spark.createDataFrame([(7, 7, 0.0), (7, 1, 0.5), (2, 7, 0.0), (3, 9, 0.0)], "class_1 long, class_2 long, degree double")
    got = users_of_classes(close, members, members)
    one, two = (members.withColumnsRenamed({"uid": f"uid_{k}", "class_id": f"class_{k}"}) for k in (1, 2))
    want = close.join(one, "class_1").join(two, "class_2").filter("uid_1 <> uid_2")
    columns = ["class_1", "class_2", "uid_1", "uid_2", "degree"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_a_thousand_large_items_are_hot(spark):
    """Each user knows one of them, so classes are few, and none is joined user by user."""
    rng = random.Random(3)
    rows = [(f"h{k}", f"u{k}-{j}", rng.randint(1, 3), 1, 2, j, 0) for k in range(1000) for j in range(12)]
    rows += [(f"i{k % 500}", f"u{k}-0", rng.randint(1, 3), 1, 2, k, 0) for k in range(1000)]
    reviews = frame(spark, rows)
    ledger = open_ledger(reviews, hot_least=10)
    assert ledger.crowd is not None and not ledger.crowd.exact
    assert ledger.crowd.known.select(F.explode("hots")).distinct().count() == 1000
    assert ledger.first.filter("item_id like 'h%'").isEmpty()
    shape = ["user_1", "user_2", "degree", "overlap"]
    for threshold in (0.0, 0.9):
        got = p.agreement_edges(reviews, threshold, hot_least=10).select(shape)
        want = p.agreement_edges(reviews, threshold).select(shape)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_hot_items_that_share_a_bit(spark, monkeypatch):
    """With one bit for all hot items, pairs that may meet are looked up."""
    monkeypatch.setattr(agreement, "MASK_BITS", 1)
    monkeypatch.setattr(agreement, "MASKS", 1)
    rng = random.Random(4)
    rows = [(f"h{rng.randrange(6)}", f"u{rng.randrange(60)}", rng.randint(1, 2), 1, 2, k, 0) for k in range(200)]
    rows += [(f"i{rng.randrange(40)}", f"u{rng.randrange(60)}", rng.randint(1, 2), 1, 2, k, 0) for k in range(200)]
    brute = Brute(rows)
    edges = p.agreement_edges(frame(spark, rows), 0.0, hot_least=10, hot_count=6).collect()
    assert {(r.user_1, r.user_2): r.degree for r in edges} == brute.edges(0.0)
    got = {(r.user_id, r.item_id): r.predicted for r in p.suggest(frame(spark, rows), "overlap", hot_least=10, hot_count=6).collect()}
    assert got == {k: pytest.approx(v) for k, v in brute.suggest("overlap").items()}


def test_reviews_without_an_item(spark):
    """They meet nothing, and make nothing hot."""
    rows = [(None, f"u{k}", 3, 1, 2, k, 0) for k in range(50)] + [(f"i{k % 9}", f"u{k}", 3, 1, 2, k, 0) for k in range(50)]
    with_hot = p.agreement_edges(frame(spark, rows), 0.0, hot_least=5, hot_count=3)
    plain = p.agreement_edges(frame(spark, rows[50:]), 0.0)
    shape = ["user_1", "user_2", "degree", "overlap"]
    assert sorted(map(tuple, with_hot.select(shape).collect())) == sorted(map(tuple, plain.select(shape).collect()))


def test_no_item_is_paired_user_by_user_in_many_slots(spark, monkeypatch):
    """Asked for slots only, an item of very many slots is hot all the same."""
    rows = [("huge", f"u{k}", k % 3, 1, 2, k, 0) for k in range(200)] + [("large", f"u{k}", k % 3, 1, 2, k, 0) for k in range(30)]
    ledger = open_ledger(frame(spark, rows), hot_least=10, hot_count=0)
    assert {r.item_id for r in ledger.first.select("item_id").distinct().collect()} == {"large"}
    monkeypatch.setattr(agreement, "MOST_SLOTS", 100)
    slots = p.peer_rank(frame(spark, rows), hot_least=10, hot_count=0).collect()
    monkeypatch.undo()
    assert sorted(p.peer_rank(frame(spark, rows), hot_least=10, hot_count=0).collect()) == sorted(slots)


def test_the_slots_query_reads_all_returns_as_one_item():
    import __spark_entry__ as entry

    assert entry.oracle_sql()["peer_rank_slots"] == entry.oracle_sql()["peer_rank_hot_item"]


def test_pairs_of_class_members_are_not_shuffled(spark, monkeypatch):
    """Pairs to leave out are looked up per block; nothing is shuffled after pairs are made."""
    monkeypatch.setattr(agreement, "MEMBER_BLOCK", 10)
    members = spark.range(200).select(F.col("id").alias("uid"), (F.col("id") % 3).alias("class_id"), F.concat(F.lit("u"), "id").alias("user_id"))
    close = spark.createDataFrame([(0, 0, 0.0), (0, 1, 0.5), (2, 0, 0.0)], "class_1 long, class_2 long, degree double")
    but = spark.createDataFrame([(0, 3), (0, 1), (2, 3), (1, 2), (6, 0)], "uid_1 long, uid_2 long")
    got = users_of_classes(close, members.filter("uid < 30"), members, but)
    want = {(a, b) for a in range(30) for b in range(200) if (a % 3, b % 3) in {(0, 0), (0, 1), (2, 0)} and a != b}
    want -= {(0, 3), (0, 1), (2, 3), (6, 0)}
    rows = got.collect()
    assert len(rows) == len(want) and {(r.uid_1, r.uid_2) for r in rows} == want
    assert all((r.user_id_1, r.user_id_2) == (f"u{r.uid_1}", f"u{r.uid_2}") for r in rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("posexplode")]


def test_suggestions_of_a_class_are_summed_once(spark, monkeypatch):
    """Only what a user's own pairs change is summed by user; items may be missing and offers in pieces."""
    from plaudit.operators import suggestions

    monkeypatch.setattr(suggestions, "OFFER_BLOCK", 5)
    rng = random.Random(9)
    rows = [("hot", f"u{k}", rng.randint(1, 2), 1, 2, k, 0) for k in range(80)]
    rows += [(f"i{rng.randrange(40)}" if k % 9 else None, f"u{rng.randrange(90)}", rng.randint(1, 5), 1, 2, k, 0) for k in range(150)]
    wide, summed = [], suggestions._means
    monkeypatch.setattr(suggestions, "_means", lambda votes, *keys: wide.append(votes.count()) or summed(votes, *keys))
    for neighbours in ("all", "overlap"):
        got, want = (
            {(r.user_id, r.item_id): pytest.approx(r.predicted) for r in p.suggest(frame(spark, rows), neighbours, hot_least=least, hot_count=1).collect()}
            for least in (50, 10**6)
        )
        assert got == want and any(item is None for _, item in got)
        assert max(wide[:2]) < len(got)
        wide.clear()


@pytest.mark.parametrize("least", [10**6, 7])
def test_pairs_are_added_up_where_lists_arrive(spark, monkeypatch, least):
    """Pairs are shuffled once, in lists; large items make a grid and heavy users are dealt."""
    monkeypatch.setattr(agreement, "PAIRS_OF_TASK", 500)
    monkeypatch.setattr(agreement, "MOST_SLOTS", 10**6)
    rng = random.Random(5)
    rows = [(f"i{rng.randrange(30)}", f"u{rng.randrange(60)}" if k % 4 else "u0", rng.randint(1, 5), rng.randrange(5), 4, k, 0) for k in range(500)]
    brute, reviews = Brute(rows), frame(spark, rows)
    ledger = open_ledger(reviews, True, least, 0)
    assert ledger.tasks > 3
    pairs = agreement.gaining_pairs(ledger, 0.9, None)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert any("uid_1" in keys for keys in dealt) and not any("uid_2" in keys for keys in dealt)
    for most in (4096, 20):
        monkeypatch.setattr(skew, "LEAST_ROWS", most)
        got = {r.user_id: r["rank"] for r in p.peer_rank(reviews, "divergence", hot_least=least, hot_count=0).collect()}
        assert got == {k: pytest.approx(v) for k, v in brute.peer_rank("divergence").items()}
        edges = {(r.user_1, r.user_2): r.degree for r in p.agreement_edges(reviews, 0.9, hot_least=least, hot_count=0).collect()}
        assert edges == {k: pytest.approx(v) for k, v in brute.edges(0.9).items()}


def test_partitions_grow_with_the_reviews(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f"i{rng.randrange(40)}", f"u{rng.randrange(60)}", rng.randint(1, 5), 1, 2, k, 0) for k in range(400)]
    plain = sorted(p.peer_rank(frame(spark, rows)).collect())
    monkeypatch.setattr(agreement, "REVIEWS_OF_TASK", 40)
    ledger = open_ledger(frame(spark, rows), True)
    assert ledger.parts == 10
    met = agreement._met_in_lists(ledger, ledger.first, ledger.second, "help")
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(item_id" in plan and ", 10), REPARTITION_BY_NUM" in plan
    assert sorted(p.peer_rank(frame(spark, rows)).collect()) == plain


def test_second_users_are_classed_by_their_latest_scores_alone(spark):
    rng = random.Random(10)
    rows = []
    for k in range(300):
        # One to four reviews of the hot item, whose latest decides about a second user.
        for time in range(rng.randint(1, 4)):
            rows.append(("hot", f"u{k}", rng.randint(1, 5), rng.randint(0, 5), 5, time, 0))
        rows.append((f"i{rng.randrange(30)}", f"u{k}", rng.randint(1, 5), 1, 2, 9, 0))
    reviews = frame(spark, rows)
    ledger = open_ledger(reviews, True, hot_least=100, hot_count=1, by_latest=True)
    assert ledger.second.filter("class_id is not null").select("class_id").distinct().count() == 5
    known = class_pairs(ledger.crowd, 0.9, others=ledger.others)
    firsts = ledger.crowd.lines.select("class_id").distinct().count()
    assert known.count() == 5 * firsts < firsts * firsts / 4
    brute = Brute(rows)
    for weight in ("divergence", "agreement"):
        got = {r.user_id: r["rank"] for r in p.peer_rank(reviews, weight, hot_least=100, hot_count=1).collect()}
        assert got == {u: pytest.approx(v, abs=1e-9) for u, v in brute.peer_rank(weight).items()}


def test_numbers_of_users_have_no_gaps(spark):
    rows = [(f"i{k % 7}", f"u{k}", 1 + k % 5, 1, 2, k, 0) for k in range(500)]
    users = open_ledger(frame(spark, rows).repartition(5)).users
    assert dict(users.dtypes)["uid"] == "int"
    assert sorted(row.uid for row in users.collect()) == list(range(500))


def lone(seed, users=40):
    rng = random.Random(seed)
    return [(f"i{rng.randrange(30)}", f"u{rng.randrange(users)}", rng.choice((1, 2.5, 4)), rng.randint(0, 3), 3, k, 0) for k in range(300)]


def test_pairs_are_shuffled_once_for_names(spark, as_planned):
    rows = lone(11)
    edges = p.agreement_edges(frame(spark, rows), 0.9, with_helpfulness=True)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin [uid_") == 2 and "MergeJoin [uid_" not in plan
    # The pairs as they are dealt, the names of first users, and the pairs once more; names are shuffled once for both.
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning(uid_" in line and "Reused" not in line]
    assert [sum(f"(uid_{k}" in line for line in shuffles) for k in (1, 2)] == [2, 1]
    brute = Brute(rows)
    got = {(r.user_1, r.user_2): (r.degree, r.overlap, r.help_1, r.help_diff) for r in edges.collect()}
    want = {(a, b): (d, brute.overlap(a, b), brute.help[a], brute.help[b] - brute.help[a]) for (a, b), d in brute.edges(0.9).items()}
    assert got == {pair: pytest.approx(values, abs=1e-9) for pair, values in want.items()}


@pytest.mark.parametrize("codes", [2, 127])
def test_scores_are_bytes_in_lists_where_they_are_few(spark, monkeypatch, codes):
    monkeypatch.setattr(agreement, "SCORE_CODES", codes)
    rows = lone(12)
    reviews = frame(spark, rows)
    assert open_ledger(reviews).scores == ([1, 2.5, 4] if codes == 127 else [])
    edges = {(r.user_1, r.user_2): r.degree for r in p.agreement_edges(reviews, 0.9).collect()}
    assert edges == {pair: pytest.approx(v, abs=1e-9) for pair, v in Brute(rows).edges(0.9).items()}


def test_entries_are_stored_and_the_reviews_go(spark):
    def tables():
        return {path.parent for path in Path(shared_dir(spark).removeprefix("file:")).glob("**/_SUCCESS")}

    before = tables()
    ledger = open_ledger(frame(spark, lopsided(3000)))
    plan = ledger.entries._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    # Only sums of the reviews stay, so times are in no table.
    columns = [spark.read.parquet(str(table)).columns for table in tables() - before]
    assert ["item_id", "score", "n", "latest", "uid"] in columns and not any("review_time" in names for names in columns)


def test_asked_users_are_stored_before_reviews_are_searched(spark, monkeypatch):
    """A stored table has a size, so that reviews are not shuffled to meet few users."""
    plans, saved = [], agreement.saved
    monkeypatch.setattr(agreement, "saved", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or saved(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        reviews = frame(spark, lopsided(3000))
        asked = reviews.filter(F.col("user_id").endswith("77")).select("user_id").distinct()
        found = agreement._on_items_of(reviews, asked).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for plan in plans for line in plan.splitlines() if "Join [user_id" in line]
    assert joins and all("BroadcastHashJoin" in line for line in joins)
    items = {r.item_id for r in reviews.join(asked, "user_id").collect()}
    assert found == reviews.filter(F.col("item_id").isin(list(items))).count() > 1000


@pytest.mark.parametrize("least", [5, 2_048])
def test_edges_are_made_in_rounds(spark, monkeypatch, least):
    """However many pairs there are, a bounded number is shuffled at a time."""
    rng = random.Random(9)
    rows = [(f"i{rng.randrange(6)}", f"u{rng.randrange(30)}", rng.randint(1, 5), rng.randrange(5), 4, k, 0) for k in range(150)]
    monkeypatch.setattr(agreement, "PAIRS_OF_ROUND", 900)
    monkeypatch.setattr(agreement, "MOST_SLOTS", 10**6)
    reviews, brute = frame(spark, rows), Brute(rows)
    many = open_ledger(reviews, True, least, 0).rounds
    assert many > 2
    rounds, stored = [], agreement.stored
    monkeypatch.setattr(agreement, "stored", lambda df, path: rounds.append(df.columns) or stored(df, path))
    for threshold in (0.0, 0.9):
        rounds.clear()
        edges = p.agreement_edges(reviews, threshold, with_helpfulness=True, hot_least=least, hot_count=0)
        # All but the last, which the edges are read with.
        assert len([columns for columns in rounds if "user_2" in columns]) == many - 1
        got = {(r.user_1, r.user_2): (r.degree, r.overlap, r.help_1, r.help_diff) for r in edges.collect()}
        assert len(got) == edges.count()
        assert got == {
            (a, b): (pytest.approx(d), brute.overlap(a, b), brute.help[a], brute.help[b] - brute.help[a])
            for (a, b), d in brute.edges(threshold).items()
        }


def test_blocks_of_members_do_not_grow_with_the_members(spark, as_planned, monkeypatch):
    """A block is written once for each first user; long ones would not compress."""
    monkeypatch.setattr(agreement, "MEMBER_BLOCK", 10)
    for n in (300, 3000):
        members = spark.range(n).select(F.col("id").alias("uid"), (F.col("id") % 2).alias("class_id"))
        lists, hot = agreement._blocks(members)
        assert lists.agg(F.max(F.size("uids"))).first()[0] <= 30 and sum(r.pieces for r in hot.collect()) == n // 10
    counts = spark.createDataFrame([("a", 10), ("b", 11), ("c", 35)], "k string, n long")
    assert sorted(map(tuple, in_pieces(counts, 10).collect())) == [("b", 2), ("c", 4)]

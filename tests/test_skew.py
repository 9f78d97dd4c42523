"""Hot items, repeats and hot users against pair-by-pair brute force."""

import random

import pytest
from fixtures import Brute, frame
from pyspark.sql import functions as F

import plaudit as p
from plaudit.operators import agreement


def skewed(seed, users=60, scores=(1, 2, 3, 4.5, 5)):
    """About a third of all rows on one item, a hot user, and repeat reviews."""
    rng = random.Random(seed)
    rows = []
    for k in range(400):
        user = "u0" if rng.random() < 0.3 else f"u{rng.randrange(users)}"
        draw = rng.random()
        item = "hot" if draw < 0.34 else "warm" if draw < 0.45 else f"i{rng.randrange(60)}"
        total = rng.randrange(8)
        rows.append((item, user, rng.choice(scores), rng.randint(0, total), total, rng.randrange(50), 0))
    return rows


def as_dict(df, *keys):
    value = [c for c in df.columns if c not in keys][0]
    rows = df.collect()
    out = {tuple(r[k] for k in keys): r[value] for r in rows}
    assert len(out) == len(rows)
    return out


def near(want):
    return {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


@pytest.fixture(autouse=True)
def interpreted(spark):
    """Many small plans run once each; compiled code is exercised by the other tests."""
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    yield
    spark.conf.unset("spark.sql.codegen.wholeStage")


# hot_least and number of hot items: none large, one, two, many, slots only, and by cost.
PLANS = [(10**6, None, 1), (60, 1, 2), (20, 2, 3), (4, 40, 4), (6, 0, 6), (6, None, 7)]


@pytest.mark.parametrize("least,count,seed", PLANS)
def test_every_plan_gives_the_brute_force_result(spark, least, count, seed):
    plan = {"hot_least": least, "hot_count": count}
    rows = skewed(seed)
    brute, reviews = Brute(rows), frame(spark, rows).cache()
    for threshold in (0.0, 0.9):
        edges = p.agreement_edges(reviews, threshold, **plan)
        assert as_dict(edges.select("user_1", "user_2", "degree"), "user_1", "user_2") == near(
            brute.edges(threshold)
        )
        overlaps = as_dict(edges.select("user_1", "user_2", "overlap"), "user_1", "user_2")
        assert overlaps == {pair: brute.overlap(*pair) for pair in brute.edges(threshold)}
    for weight in ("divergence", "agreement"):
        got = as_dict(p.peer_rank(reviews, weight, **plan), "user_id")
        assert got == near({(u,): v for u, v in brute.peer_rank(weight).items()})
    for neighbours in ("all", "multi", "overlap"):
        got = as_dict(p.suggest(reviews, neighbours, **plan), "user_id", "item_id")
        assert got == near(brute.suggest(neighbours))
    some = reviews.filter("user_id in ('u0', 'u3', 'u17')").select("user_id").distinct()
    asked = as_dict(p.suggest(reviews, "overlap", users=some, **plan), "user_id", "item_id")
    assert asked == near({k: v for k, v in brute.suggest("overlap").items() if k[0] in ("u0", "u3", "u17")})
    edges = p.agreement_edges(reviews, 0.9, users=some, **plan).select("user_1", "user_2", "degree")
    assert as_dict(edges, "user_1", "user_2") == near(
        {k: v for k, v in brute.edges(0.9).items() if k[0] in ("u0", "u3", "u17")}
    )
    unseen = as_dict(p.suggest(reviews, exclude_seen=True, **plan), "user_id", "item_id")
    assert unseen == near(brute.suggest("all", exclude_seen=True))
    reviews.unpersist()


def test_hot_item_is_left_out_of_the_join(spark):
    reviews = frame(spark, skewed(3))
    ledger = agreement.open_ledger(reviews, hot_least=60, hot_count=1)
    assert ledger.crowd is not None
    assert ledger.first.filter("item_id = 'hot'").isEmpty()
    assert ledger.crowd.members.count() == reviews.filter("item_id = 'hot'").select("user_id").distinct().count()


def test_positive_edges_carry_helpfulness(spark):
    rows = skewed(4)
    brute = Brute(rows)
    df = p.agreement_edges(frame(spark, rows), 0.9, with_helpfulness=True, positive_only=True)
    got = {(r.user_1, r.user_2): (r.help_1, r.help_diff) for r in df.collect()}
    want = {
        (a, b): (brute.help[a], brute.help[b] - brute.help[a])
        for a, b in brute.edges(0.9)
        if brute.help[b] > brute.help[a]
    }
    assert got == want


def test_peer_rank_bounds(spark):
    reviews = frame(spark, skewed(5))
    joined = p.peer_rank(reviews).join(p.user_helpfulness(reviews), "user_id")
    assert joined.filter((F.col("rank") < F.col("help")) | (F.col("rank") > 100)).isEmpty()


def test_row_order_and_partitions_do_not_matter(spark):
    rows = skewed(6)
    first = frame(spark, rows)
    other = frame(spark, rows[::-1]).repartition(5)
    for fn in (p.suggest, p.peer_rank, p.consensus_rank):
        assert sorted(map(tuple, fn(first).collect())) == sorted(map(tuple, fn(other).collect()))

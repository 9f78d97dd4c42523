"""Hand-checked results on thirteen reviews."""

import pytest
from fixtures import MICRO, SCHEMA, Brute, frame

import plaudit as p


@pytest.fixture(scope="module")
def reviews(spark):
    return frame(spark, MICRO).cache()


def table(df, *keys):
    rows = df.collect()
    value = [c for c in df.columns if c not in keys][0]
    out = {(r[keys[0]] if len(keys) == 1 else tuple(r[k] for k in keys)): r[value] for r in rows}
    assert len(out) == len(rows)
    return out


def close(got, want):
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


def test_item_score(reviews):
    close(table(p.item_score(reviews), "item_id"), {"A": 4.6, "B": 3, "C": 5 / 3, "D": 4, "E": 2})


def test_user_score(reviews):
    close(
        table(p.user_score(reviews), "user_id"),
        {"u1": 4, "u2": 10 / 3, "u3": 3, "u4": 3.5, "u5": 2},
    )


def test_user_helpfulness(reviews):
    df = p.user_helpfulness(reviews)
    assert dict(df.dtypes)["help"] == "double"
    close(table(df, "user_id"), {"u1": 56, "u2": 52, "u3": 66, "u4": 57, "u5": 0})


def test_length_helpfulness_in_class_order(reviews):
    rows = [tuple(r) for r in p.length_helpfulness(reviews).collect()]
    assert rows == [("< 0", 66), ("< 1024", 66), ("< 2048", 66), ("< 4096", 100)]


def test_length_classes_sort_by_number(spark):
    rows = [("A", "u", 1, 1, 1, 0, n) for n in (10240, 2048, 0)]
    got = [r[0] for r in p.length_helpfulness(frame(spark, rows)).collect()]
    assert got == ["< 0", "< 2048", "< 10240"]


SCORES = {("A", 4): 60, ("A", 5): 80, ("B", 3): 66, ("C", 1): 100, ("C", 2): 0, ("D", 4): 100}


def test_helpfulness_by_score(reviews):
    close(table(p.helpfulness_by_score(reviews), "item_id", "score"), SCORES)
    close(table(p.helpfulness_by_score(reviews, "A"), "score"), {4.0: 60, 5.0: 80})


YEARS = {
    ("A", "1999"): 4, ("A", "2000"): 5, ("A", "2003"): 5, ("A", "2008"): 4, ("B", "1970"): 3,
    ("B", "2008"): 3, ("B", "2009"): 3, ("C", "2009"): 2, ("C", "2010"): 1, ("D", "2000"): 4,
    ("E", "2011"): 2,
}
PERIODS = {
    ("A", "1997-2002"): 4.67, ("A", "2003-2007"): 4.5, ("B", "1997-2002"): 3, ("B", "2008-2012"): 3,
    ("C", "2008-2012"): 1.67, ("D", "1997-2002"): 4, ("E", "2008-2012"): 2,
}


@pytest.mark.parametrize("fn,key,want", [(p.item_year_score, "year", YEARS), (p.item_period_score, "period", PERIODS)])
def test_scores_over_time(reviews, fn, key, want):
    got = table(fn(reviews), "item_id", key)
    assert got == want
    assert table(fn(reviews, "A"), "item_id", key) == {k: v for k, v in want.items() if k[0] == "A"}


def test_rounding_is_half_up_on_the_binary_value(spark):
    rows = frame(spark, [("A", "u", 1.005, 0, 0, 0, 0), ("B", "u", 2.125, 0, 0, 0, 0)])
    assert table(p.item_year_score(rows), "item_id", "year") == {("A", "1970"): 1.0, ("B", "1970"): 2.13}


def test_consensus_rank(reviews):
    want = {"u1": 64.5, "u2": 59.0, "u3": 232 / 3, "u4": 377 / 6, "u5": 0}
    got = table(p.consensus_rank(reviews), "user_id")
    close(got, {**want, "u4": 62.833333})


def test_consensus_rank_is_the_mean_of_the_single_item_lifts(reviews):
    lifts = {}
    for item in "ABCDE":
        for row in p.consensus_lift(reviews, item).collect():
            lifts.setdefault(row.user_id, []).append(row.lifted_help)
    close(table(p.consensus_rank(reviews), "user_id"), {u: sum(v) / len(v) for u, v in lifts.items()})


def test_peer_rank(reviews):
    close(
        table(p.peer_rank(reviews, "divergence"), "user_id"),
        {"u1": 56, "u2": 52, "u3": 66, "u4": 61.5, "u5": 0},
    )
    close(
        table(p.peer_rank(reviews, "agreement"), "user_id"),
        {"u1": 57, "u2": 56.5, "u3": 66, "u4": 61.5, "u5": 52},
    )


ALL = {
    ("u1", "A"): 14 / 3, ("u1", "B"): 3, ("u1", "C"): 2, ("u1", "E"): 2, ("u2", "A"): 14 / 3,
    ("u2", "B"): 3, ("u2", "C"): 2, ("u2", "E"): 2, ("u5", "A"): 5, ("u5", "B"): 3, ("u5", "C"): 2,
}


def test_suggest(reviews):
    key = ("user_id", "item_id")
    close(table(p.suggest(reviews), *key), ALL)
    close(table(p.suggest(reviews, "multi"), *key), {k: v for k, v in ALL.items() if k != ("u2", "C")})
    close(table(p.suggest(reviews, "overlap"), *key), {**ALL, ("u1", "A"): 4.625, ("u2", "A"): 4.625})


def test_unseen_suggestions_agree_for_all_and_multi(reviews):
    key = ("user_id", "item_id")
    unseen = table(p.suggest(reviews, exclude_seen=True), *key)
    close(unseen, Brute(MICRO).suggest("all", exclude_seen=True))
    close(table(p.suggest(reviews, "multi", exclude_seen=True), *key), unseen)


def test_user_items_keeps_repeats(reviews):
    got = {(r.user_id, r.item_id, r.score): r.n for r in p.user_items(reviews).collect()}
    assert got["u4", "A", 4.0] == got["u4", "A", 5.0] == 1
    assert sum(got.values()) == len(MICRO)


def test_unknown_options(reviews):
    with pytest.raises(ValueError):
        p.peer_rank(reviews, "naive")
    with pytest.raises(ValueError):
        p.suggest(reviews, "some")


def test_unreadable_scores_and_times(spark):
    """A null score counts as a review, agrees with nothing and predicts nothing."""
    rows = [("A", "u1", 5.0, 1, 2, 5, 0), ("A", "u2", 4.0, 1, 1, 5, 0), ("B", "u1", 3.0, 0, 0, 5, 0)]
    rows += [("C", "u3", 2.0, 0, 0, 7, 0), ("B", "u3", 3.0, 0, 0, None, 0), ("F", "u3", 2.0, 0, 0, 9, 0)]
    data = [(i, u, s, up, total, t, n, up * 100 // total if total else None) for i, u, s, up, total, t, n in rows]
    data += [("B", "u2", None, 0, 0, 9, 0, None), ("F", "u3", None, 0, 0, 99, 0, None), ("A", "u2", None, 0, 4, 99, 0, 0)]
    reviews = spark.createDataFrame(data, SCHEMA)
    edges = {(r.user_1, r.user_2): r.degree for r in p.agreement_edges(reviews, 9.0).collect()}
    assert edges == {("u1", "u2"): 1.0, ("u2", "u1"): 1.0, ("u1", "u3"): 0.0, ("u3", "u1"): 0.0}
    got = {(r.user_id, r.item_id): r.predicted for r in p.suggest(reviews).collect()}
    assert got == {("u1", "C"): 2.0, ("u1", "B"): 3.0, ("u1", "F"): 2.0, ("u3", "A"): 5.0, ("u3", "B"): 3.0}
    assert {r.user_id: r.help for r in p.user_helpfulness(reviews).collect()} == {"u1": 25.0, "u2": 33.0, "u3": 0.0}
    periods = {(r.item_id, r.period): r.mean_score for r in p.item_period_score(reviews, "B").collect()}
    assert periods == {("B", "1997-2002"): 3.0, ("B", None): 3.0}

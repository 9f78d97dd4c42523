import random
import zlib

import xxhash
from helpers import DOCUMENTS, near_copy, row, texts

from plaudit.llm import toxicity
from plaudit.llm.toxicity import features, fit_label_model, toxicity_scores

LABELS = "doc_id long, quality int, toxic int, text string"


def corpus():
    rng = random.Random(9)
    stems = ["gribal", "fontur"]
    rows, labels = [], []
    for i, text in enumerate(texts(10, 900, 40)):
        toxic = i % 6 == 0
        words = text.split()
        if toxic:
            for _ in range(3):
                bad = rng.choice(["scumbag", "blockhead", stems[0] + rng.choice(["a", "on", "ex"]), stems[1] + rng.choice(["i", "us"])])
                words.insert(rng.randrange(len(words)), bad)
        rows.append(row(i, " ".join(words)))
        # A few labels are wrong.
        labels.append((i, 1, int(toxic) if i % 97 else 1, "clash"))
    return rows, labels


def test_held_out_rows_are_told_apart(spark):
    rows, labels = corpus()
    rows += [row(5000, None), row(5001, ""), row(5002, "You blockhead"), row(None, "scumbag " * 5000), rows[6]]
    labels += [(None, 1, 1, ""), (5000, 1, None, ""), (9999, 0, 1, ""), (5001, 0, 7, "")]
    found = toxicity_scores(spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    for r in found:
        text = "" if r.doc_id is None else str(r.doc_id)
        assert r.held_out == (zlib.crc32(text.encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 900]
    hits = sum(r.predicted for r in held if r.doc_id % 6 == 0)
    assert hits >= 0.95 * sum(r.doc_id % 6 == 0 for r in held)
    assert sum(r.predicted for r in held if r.doc_id % 6) <= 0.02 * len(held)
    assert by_id[5000].score == by_id[5001].score < 0.5 and by_id[None].predicted


def test_held_out_labels_teach_nothing(spark):
    rows, labels = corpus()
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t, x) for i, q, t, x in labels]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    one, two = (
        sorted(map(str, toxicity_scores(docs, spark.createDataFrame(y, LABELS)).collect())) for y in (labels, turned)
    )
    assert one == two


def test_only_near_copies_are_thinned(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1]
    # Two words whose hashes are below those of all others.
    least = sorted((f"w{i}" for i in range(20_000)), key=lambda w: xxhash.xxh3_64_intdigest(w) >> 1)[:2]
    unlike = [f"{t} {' '.join(least)}" for t in texts(13, 60, 40)]
    rows = [row(i, t) for i, t in zip(ids, unlike)]
    labels = [(i, 1, int(n % 2), "") for n, i in enumerate(ids)]
    # A copy and near copies of the first text: even places are clean, odd ones toxic.
    copies = [unlike[0].upper().replace(" ", "  "), unlike[0], near_copy(unlike[0], 1, 1), near_copy(unlike[0], 2, 1)]
    rows += [row(i, t) for i, t in zip(ids[60::2], [copies[0], copies[2], copies[3]])] + [row(ids[63], near_copy(unlike[1], 3, 1))]
    docs, labels = spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame(labels, LABELS)
    found = toxicity._sample(docs, labels).collect()
    assert len(found) == 60 and sum(r.toxic for r in found) == 30
    # A copy labelled otherwise is toxic; a near copy labelled otherwise stays beside the clean one.
    more = docs.union(spark.createDataFrame([row(ids[65], copies[1]), row(ids[67], near_copy(unlike[2], 4, 1))], DOCUMENTS))
    found = toxicity._sample(more, labels).collect()
    assert len(found) == 62 and sum(r.toxic for r in found) == 32


def test_patterns_and_all_families_vote(spark, monkeypatch):
    names = [f"{i:04d}x" for i in range(400)]
    voter = toxicity.voters_of(["!shout", *names])
    assert set(voter) == set(range(toxicity.VOTERS)) and (voter[1:] >= 1).all()
    fired = [[1 + i] for i in range(400)] * 2
    seen = []
    monkeypatch.setattr(toxicity, "fit_label_model", lambda votes, start: seen.append(votes) or fit_label_model(votes, start))
    toxicity.fit(["!shout", *names], fired, toxicity.np.zeros(800))
    assert (seen[0][:, :-1].sum(1) == 1).all()

    monkeypatch.setattr(toxicity, "LEXICON_ENTRIES", 5)
    rows, labels = corpus()
    rows[1] = row(1, rows[1][1] + " well!!")
    docs = spark.createDataFrame(rows, DOCUMENTS)
    weights = toxicity.train(docs, spark.createDataFrame(labels, LABELS))
    assert "!exclaim" in weights and len(weights) == 6


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCUMENTS), spark.createDataFrame([], LABELS)
    assert toxicity_scores(docs, labels).count() == 0
    found = toxicity_scores(spark.createDataFrame([row(1, "x")], DOCUMENTS), labels).collect()
    assert found[0].predicted == 0


def test_label_model_discounts_repeated_voters():
    import numpy as np

    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.2
    good = [np.where(rng.random(4000) < 0.85, truth, ~truth) for _ in range(3)]
    copy = np.where(rng.random(4000) < 0.6, truth, ~truth)
    label = np.where(rng.random(4000) < 0.97, truth, ~truth)
    votes = np.stack([*good, copy, copy, copy, copy, label], 1).astype(np.float32)
    model = fit_label_model(votes, np.where(label, 0.9, 0.05))
    assert model.shares[3:7].max() < 0.5 < model.shares[:3].min()
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.95
    assert model.rates[1][0] > 0.75 > model.rates[1][3]


def test_features():
    assert {"gribalon", "griba-", "gribal-2", "!exclaim"} <= features("Gribalon gribala!!")

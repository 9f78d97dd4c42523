"""Toxicity by weak supervision: voters, a generative label model, a linear classifier."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from plaudit.llm.minhash import near_duplicates
from plaudit.sources.shared import saved

# The classifier is fitted on so many labelled rows at most, those with the least hashed doc_id;
# lexicons hold so many entries at most. Both bound what reaches the driver.
TRAINING_ROWS = 20_000
LEXICON_ENTRIES = 3_000
# Voters at most; families beyond them share the last few.
VOTERS = 256
JOINT_VOTERS = 8
# Lengths of word beginnings that count as entries beside whole words: a stem's many endings.
STEMS = (4, 5, 6, 7, 8)
# A beginning is one more entry when so many different words of a text share it.
REPEATS = (2, 3)
# Letters by which entries are put together into one lexicon, that is one voter.
FAMILY = 4
# An entry's share of toxic rows has to be above the base rate by this factor at 4 standard errors.
LIFT, ERRORS = 1.5, 4.0
# How often the given label says toxic on clean and on toxic texts. Estimated freely, it would
# lose against the lexicons and the toxic class would shrink to what most of them agree on.
LABEL_RATES = (0.01, 0.95)
THRESHOLD = 0.7
HELD_OUT_MODULUS, HELD_OUT = 3, 1
WORDS_KEPT = 300_000

# Voters that look at the form of a text.
PATTERNS = {
    "!exclaim": re.compile(r"!{2,}"),
    "!masked": re.compile(r"\b\w[*@#$]{2,}\w*"),
    "!shout": re.compile(r"\b[A-ZÀ-Þ]{4,}\W+[A-ZÀ-Þ]{4,}\W+[A-ZÀ-Þ]{4,}\b"),
    "!stretch": re.compile(r"(\w)\1{4,}"),
}
_WORD = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id as text leaves ``HELD_OUT`` by ``HELD_OUT_MODULUS``; null counts as text ''."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % HELD_OUT_MODULUS == HELD_OUT


def entries(word: str) -> list[str]:
    """The word and its beginnings, which end in ``-``."""
    return [word, *(word[:n] + "-" for n in STEMS if len(word) > n)]


def repeated(stems: Counter) -> list[str]:
    """``stem2`` and so on for the beginnings that several words of a text share."""
    return [f"{stem}{n}" for stem, times in stems.items() for n in REPEATS if times >= n]


def features(text: str) -> set[str]:
    stems: Counter = Counter()
    for word in set(_WORD.findall(text.lower())):
        stems.update(entries(word))
    found = {*stems, *repeated(Counter({s: n for s, n in stems.items() if s.endswith("-")}))}
    found.update(name for name, pattern in PATTERNS.items() if pattern.search(text))
    return found


@dataclass
class LabelModel:
    """Rates at which each voter speaks on clean and on toxic texts, and how far it repeats others."""

    prior: float
    rates: np.ndarray
    shares: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        speaks = np.log(self.rates[1] / self.rates[0])
        silent = np.log((1 - self.rates[1]) / (1 - self.rates[0]))
        odds = np.log(self.prior / (1 - self.prior)) + votes @ (self.shares * speaks) + (1 - votes) @ (self.shares * silent)
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def fit_label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 15) -> LabelModel:
    """Expectation maximisation from the posteriors ``start``; the last voter is the given label.

    Given the class, voters are correlated: two lexicons that fire on the same texts bring the
    evidence of one. Each round estimates these correlations within the classes, and a voter
    counts with the share 1 / (1 + sum of its correlations with others).
    """
    q = start
    for _ in range(rounds):
        mass = np.stack([1 - q, q])
        total = mass.sum(1)
        rates = np.clip((mass @ votes + 0.05) / (total[:, None] + 1.0), 1e-5, 1 - 1e-5)
        rates[:, -1] = LABEL_RATES
        expected = (1 - q)[:, None] * rates[0] + q[:, None] * rates[1]
        off = votes - expected
        spread = np.sqrt((off * off).sum(0)) + 1e-9
        related = np.clip((off.T @ off) / np.outer(spread, spread), 0, 1)
        np.fill_diagonal(related, 0)
        related[related < 0.1] = 0
        shares = 1 / (1 + related.sum(1))
        shares[-1] = 1
        model = LabelModel(float(np.clip(total[1] / len(q), 1e-4, 0.9)) if len(q) else 0.1, rates, shares)
        q = model.posterior(votes)
    return model


def fit_linear(rows: np.ndarray, columns: np.ndarray, n: int, width: int, goal: np.ndarray, steps: int = 400) -> np.ndarray:
    """Logistic regression on sparse 0/1 features against probabilities; the last weight is the constant."""
    weights, ahead, t = np.zeros(width + 1), np.zeros(width + 1), 1.0
    per_row = np.bincount(rows, minlength=n) if n else np.zeros(0)
    penalty = 2e-5
    rate = 4.0 / (1 + (per_row.max() if n else 0)) * 4
    for _ in range(steps if n else 0):
        z = np.bincount(rows, ahead[columns], n) + ahead[-1]
        off = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - goal) / n
        slope = np.append(np.bincount(columns, off[rows], width), off.sum())
        slope[:-1] += penalty * ahead[:-1]
        new = ahead - rate * slope
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - weights)
        weights, t = new, t_new
    return weights


def voters_of(lexicon: list[str]) -> np.ndarray:
    """The voter of each entry: entries that begin alike share one, a pattern has its own.

    Of more than ``VOTERS`` the last are put together, neighbours in the lexicon's order, into
    ``JOINT_VOTERS``.
    """
    names = [e if e.startswith("!") else e.rstrip("-23")[:FAMILY] + e[-1] * e.endswith(("-2", "-3")) for e in lexicon]
    number = {name: i for i, name in enumerate(dict.fromkeys(names))}
    voter = np.array([number[name] for name in names], np.int64)
    own = VOTERS - JOINT_VOTERS
    if len(number) > VOTERS:
        voter = np.where(voter < own, voter, own + (voter - own) * JOINT_VOTERS // (len(number) - own))
    return voter


def fit(lexicon: list[str], fired: list[list[int]], toxic: np.ndarray) -> dict[str, float]:
    """Weights by entry, and under '' the constant, from the entries found in each training row."""
    n, width = len(fired), len(lexicon)
    rows = np.repeat(np.arange(n), [len(f) for f in fired])
    columns = np.array([c for f in fired for c in f], np.int64)
    voter = voters_of(lexicon)
    votes = np.zeros((n, (voter.max() + 1 if width else 0) + 1), np.float32)
    votes[rows, voter[columns]] = 1
    # The given label is a voter too, as it may be wrong.
    votes[:, -1] = toxic
    if not n:
        return {"": -5.0}
    goal = fit_label_model(votes, np.where(toxic == 1, 0.9, 0.02)).posterior(votes)
    weights = fit_linear(rows, columns, n, width, goal)
    return {**dict(zip(lexicon, map(float, weights), strict=False)), "": float(weights[-1])}


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``toxic, text`` of the training rows: of near copies, one of each label.

    Copies, texts that differ in case and white space only, are one row, toxic if any is, with the
    text of the least hashed doc_id. Of a class of near copies the least hashed text of each label
    stays: where labels differ, what parts the texts is what they teach.
    """
    train = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(TRAINING_ROWS)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    plain = F.trim(F.regexp_replace(F.lower("text"), r"[\x20\x09-\x0D]+", " "))
    # At most TRAINING_ROWS pairs of numbers, so broadcasting them is safe at every size.
    rows = texts.join(F.broadcast(train), "doc_id").withColumn("copy", F.shiftrightunsigned(F.xxhash64(plain), 1))
    first = F.min_by("text", F.struct(F.xxhash64("doc_id"), "doc_id", "text")).alias("text")
    rows = saved(rows.groupBy("copy").agg(F.max("toxic").alias("toxic"), first))
    near = near_duplicates(rows.select(F.col("copy").alias("doc_id"), "text"))
    classes = rows.select("copy", "toxic").join(near.select(F.col("doc_id").alias("copy"), "component_id"), "copy")
    kept = classes.groupBy("component_id", "toxic").agg(F.min("copy").alias("copy")).select("copy")
    return rows.join(kept, "copy", "left_semi").select("toxic", "text")


def train(docs: DataFrame, labels: DataFrame) -> dict[str, float]:
    """The classifier's weights; see ``toxicity_scores``."""
    sample = saved(_sample(docs, labels))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for entry in features(text):
                    seen.setdefault(entry, [0, 0])[toxic] += 1
        for start in range(0, len(seen), 20_000):
            part = list(seen.items())[start : start + 20_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([e for e, _ in part]), pa.array([n[0] for _, n in part], pa.int64()), pa.array([n[1] for _, n in part], pa.int64())],
                names=["entry", "clean", "toxic"],
            )

    totals = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    base = totals.toxic / max(1, totals.n)
    n = F.col("clean") + F.col("toxic")
    z = ERRORS**2
    share = F.col("toxic") / n
    # Wilson's lower bound of the share of toxic rows among those with the entry.
    lower = (share + z / (2 * n) - ERRORS * F.sqrt(share * (1 - share) / n + z / (4 * n * n))) / (1 + z / n)
    chosen = (
        sample.select("toxic", "text")
        .mapInArrow(count, "entry string, clean long, toxic long")
        .groupBy("entry")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .withColumn("lower", lower)
        .where((F.col("lower") > LIFT * base) | F.col("entry").isin(list(PATTERNS)))
        .orderBy(F.desc(F.col("entry").isin(list(PATTERNS))), F.desc("lower"), "entry")
        .limit(LEXICON_ENTRIES)
        .select("entry")
    )
    lexicon = [row["entry"] for row in chosen.collect()]
    place = {entry: i for i, entry in enumerate(lexicon)}

    def fire(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[place[e] for e in features(text) if e in place] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "fired"]
            )

    rows = sample.select("toxic", "text").mapInArrow(fire, "toxic int, fired array<int>").collect()
    return fit(lexicon, [sorted(r["fired"]) for r in rows], np.array([r["toxic"] for r in rows], np.float64))


def scored(docs: DataFrame, weights: dict[str, float], name: str = "score") -> DataFrame:
    """``docs``, which has no column ``name``, with the score of every row's whole ``text`` in it."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [(p, weights[entry]) for entry, p in PATTERNS.items() if weights.get(entry)]
        known_stems = {e.rstrip("23") for e in weights if e[-2:-1] == "-"}
        known: dict[str, tuple[str, ...]] = {}

        def score(text: str) -> float:
            stems: Counter = Counter()
            for word in set(_WORD.findall(text.lower())):
                own = known.get(word)
                if own is None:
                    if len(known) >= WORDS_KEPT:
                        known.clear()
                    own = tuple(e for e in entries(word) if e in known_stems or e in weights)
                    if len(word) < 64:
                        known[word] = own
                if own:
                    stems.update(own)
            found = {e for e in (*stems, *repeated(stems)) if e in weights}
            z = weights[""] + sum(sorted(weights[e] for e in found)) + sum(w for p, w in patterns if p.search(text))
            return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                scores = [score(text or "") for text in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names=[*part.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs(doc_id, text)``.

    Words and word beginnings that labelled rows show to be telling become lexicons; these and
    patterns are the voters. The label model estimates how often each speaks on clean and toxic
    texts and how far voters repeat each other, taking the given label as one more voter of known accuracy. A
    logistic regression on the entries learns its posteriors and scores every text. Held-out
    rows, by the checksum of doc_id, teach nothing; near copies of a labelled text, by ``near_duplicates``, teach once for each label.
    At most ``TRAINING_ROWS`` labelled rows are used, fewer where there are fewer. The lexicon
    holds ``LEXICON_ENTRIES`` entries at most, patterns first; they vote as at most ``VOTERS``
    voters, the last of which are joint ones of several families.

    Null and empty texts get the score of a text without any entry. Labels that are null, not 0
    or 1, or of unknown documents are ignored; a document labelled both ways is toxic. Without
    labels every score is low. Repeated rows stay. Other columns are ignored.
    """
    result = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels))
    return result.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )

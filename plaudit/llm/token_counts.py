"""Token counts of a unigram tokenizer, without its tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# The mark of a word's start, and what an unknown character scores below the
# worst piece.
MARK = "▁"
UNKNOWN_PENALTY = 10.0
WORDS_KEPT = 400_000


def default_vocabulary() -> str:
    """Path of the public SentencePiece file whose pieces and scores are the unigram vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces with scores; control, unknown and single-byte entries are no pieces of text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        (model.id_to_piece(i), model.get_score(i))
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]


class Counter:
    """How many pieces the best segmentation of a text has.

    Spaces become word marks, a text starts with one, and no piece reaches beyond the next mark,
    so words are counted apart and their counts are kept. In a word an Aho-Corasick automaton
    gives the pieces that end at each place. The best score of a place only gives way to a
    greater one, and longer pieces, which start earlier, are tried first: of equal scores the
    longest last piece wins. A character that is no piece itself is unknown; unknown characters
    in a row are one piece.
    """

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self._automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self._automaton.add_word(piece, (len(piece), score))
        self._automaton.make_automaton()
        self._unknown = min((score for _, score in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self._kept: dict[str, int] = {}

    def word(self, word: str) -> int:
        best: list[float | None] = [0.0, *[None] * len(word)]
        # Pieces on the best way to each place, and whether its last one is unknown.
        pieces, unknown = [0] * len(best), [False] * len(best)
        ends: dict[int, list[tuple[int, float]]] = {}
        for last, found in self._automaton.iter(word):
            ends.setdefault(last + 1, []).append(found)
        for end in range(1, len(best)):
            here = sorted(ends.get(end, ()), key=lambda found: -found[0])
            for length, score in here:
                candidate = best[end - length] + score
                if best[end] is None or candidate > best[end]:
                    best[end], pieces[end], unknown[end] = candidate, pieces[end - length] + 1, False
            if not here or here[-1][0] != 1:
                candidate = best[end - 1] + self._unknown
                if best[end] is None or candidate > best[end]:
                    best[end], unknown[end] = candidate, True
                    pieces[end] = pieces[end - 1] + (not unknown[end - 1])
        return pieces[-1]

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        words = text.replace(" ", MARK).split(MARK)
        # A text that starts with a mark has nothing before it; any other gets one.
        words = words[1:] if not words[0] else words
        total = 0
        for word in words:
            count = self._kept.get(word)
            if count is None:
                if len(self._kept) >= WORDS_KEPT:
                    self._kept.clear()
                count = self.word(MARK + word)
                if len(word) < 64:
                    self._kept[word] = count
            total += count
        return total


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_tokens`` for each row of ``docs(doc_id, text)``, over whole texts.

    Null and empty texts have no tokens. Repeated rows stay. An empty table gives no rows. Other
    columns are ignored. Rows need nothing of each other, so there is no shuffle.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(read_vocabulary(path))
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                found = [count(text) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long")

from helpers import DOCUMENTS, odd_documents, texts
from tokenizers import Tokenizer, models, pre_tokenizers

from plaudit.llm.token_counts import Counter, default_vocabulary, read_vocabulary, token_counts


def unigram(vocabulary):
    tokenizer = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary], 0, False))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", True)
    # The unknown entry's own score must not be the least of all.
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def test_ties_and_unknowns():
    vocabulary = [("▁", -3.0), ("a", -1.0), ("aa", -2.0), ("ab", -2.0), ("b", -1.0), ("▁a", -4.0), ("aba", -3.0), ("bab", -3.0), ("▁ab", -5.0)]
    count, plain = Counter(vocabulary), unigram(vocabulary)
    for text in ["", " ", "  ", "a", "ab", "aba", "abab", "babab aab", "axxb yx", " a", "a ", "▁a", "é\nab\tb", "xyz" * 50, "aab" * 400]:
        assert count(text) == plain(text), text


def test_public_vocabulary():
    vocabulary = read_vocabulary(default_vocabulary())
    count, plain = Counter(vocabulary), unigram(vocabulary)
    for text in [r[1] for r in odd_documents()] + texts(11, 20) + ["Ünï çødé 123, it's fine. 汉字 🙂", "<s> </s> <unk> <0x0A>"]:
        assert count(text) == plain(text), (text or "")[:50]


def test_table(spark):
    rows = odd_documents()
    count = Counter(read_vocabulary(default_vocabulary()))
    found = token_counts(spark.createDataFrame(rows, DOCUMENTS)).collect()
    assert sorted(map(str, ((r.doc_id, r.n_tokens) for r in found))) == sorted(str((r[0], count(r[1]))) for r in rows)
    assert token_counts(spark.createDataFrame([], DOCUMENTS)).count() == 0

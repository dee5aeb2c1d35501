"""Counts of trigrams: those of every plain chunk, repeats included, without a Python loop over the chunks."""

from collections import Counter

import pytest

from tidemark.llm import toxicity as X

TEXTS = ["", " ", "a", "Ab ab, (ab) a-b x1y aaa baab aa \"quoted\" don't ... … ¿qué?", " ÄÖ ß İx ΣΑΣ 漢字 \x1cq\x85z 𝒳y 12 $ab ab! -- -a-",
         "'aa'a bbb,bb cc\n\ncc", "aa aab ab", "٣x ªº ⅷ ²a b² áb"]


def slow(texts, grams):
    for text in texts:
        for chunk in text.lower().split():
            if word := X.plain(chunk):
                line = f"  {word} "
                grams.update(line[i:i + 3] for i in range(len(word) + 1))
    return grams


@pytest.mark.parametrize("cells", [X.TABLE_CELLS, 1])
def test_counts_of_plain_chunks(monkeypatch, cells):
    monkeypatch.setattr(X, "TABLE_CELLS", cells)
    for texts in [*([t] for t in TEXTS), TEXTS]:
        grams = Counter()
        X.count_plain("\n".join(t.lower() for t in texts), grams)
        assert grams == slow(texts, Counter())


def test_long_texts_are_counted_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(X, "LETTERS_AT_ONCE", 40)
    long = " ".join([*TEXTS * 5, "abcdefg" * 20, "-" + "xyz" * 40, "zzz" * 50])
    assert all(len(p) <= 40 or " " not in p for p in X.pieces(long)) and " ".join(X.pieces(long)).split() == long.split()
    docs = spark.createDataFrame([(t,) for t in [*TEXTS, None, long, long]], "text string")
    assert {r.gram: r.n for r in X.count_trigrams(docs).collect()} == slow([*TEXTS, long, long], Counter())


def test_plain_chunks_are_not_looped_over(monkeypatch):
    monkeypatch.setattr(X, "plain", None)
    grams = Counter()
    X.count_plain("ab ab", grams)
    assert grams == {"  a": 2, " ab": 2, "ab ": 2}

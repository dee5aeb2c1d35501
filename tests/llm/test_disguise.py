"""Disguises that need decoding across chunks, of doubled letters, and of words without a letter."""

import os

import pytest

from tidemark.llm import toxicity
from tidemark.llm.common import prepare, table

DATA = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not present")
LINE = "The and attion to thanedble the, anea. Eriner thanea. Anat with by of nteres. {} ertion anre"


@pytest.fixture(scope="module")
def model(spark):
    prepare(spark)
    return toxicity.fit(table(spark, DATA, "documents"), table(spark, DATA, "labels"))


def test_spaces_and_doubled_letters(model):
    scorer = toxicity.Scorer(model)
    assert scorer.score(LINE.format("thanea").encode()) < 0.2
    forms = ("id iot", "st upid", "i d io t", "stu pid.", "1d 10t", "l o ser", "iddiot", "lloser", "mooron", "id diot", "wor thle ss")
    missed = [w for w in forms if scorer.score(LINE.format(w).encode()) <= 0.5]
    assert not missed


def test_words_without_letters(model):
    trigrams = dict(model.trigrams)
    for gram in ("  a", " as", "ass", "ss "):
        trigrams[gram] = trigrams.get(gram, 0) + 1_000
    scorer = toxicity.Scorer(toxicity.Model(trigrams, {**model.weights, "ass ": 9.0}, model.coefficients))
    assert all("ass" in scorer.letters.words(w) for w in ("@$$", "455", "4$5"))
    assert all(scorer.score(LINE.format(w).encode()) > 0.5 for w in ("@$$", "455", "@ $$"))
    assert scorer.letters.words("...") == [] and scorer.letters.words("—") == []

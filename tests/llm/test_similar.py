"""The near-dedup stage of the pipeline against brute-force Jaccard similarity of five-word shingles."""

import os

import pytest

import corpus_pipeline
from tidemark.llm import similar
from tidemark.llm.common import prepare, table

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not present")


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def kept(rows):
    """Smallest ids of the groups that links of similarity 0.8 or more make."""
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    order = sorted(sets)
    for n, i in enumerate(order):
        for j in order[n + 1:]:
            a, b = root(i), root(j)
            small, large = sorted((len(sets[i]), len(sets[j])))
            if a != b and small >= 0.8 * large and jaccard(sets[i], sets[j]) >= 0.8:
                label[max(a, b)] = min(a, b)
    return sorted(i for i in order if root(i) == i)


def test_near_dedup_stage_on_documents(spark):
    """Pairs of similarity 0.8 or more go though they differ in more than four SimHash bits, others stay though they do not."""
    docs = table(prepare(spark), DATA, "documents")
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, DATA)
    assert sorted(r.doc_id for r in stage.collect()) == kept([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("common", [32, 1])
def test_common_lines_and_chains(spark, common, monkeypatch):
    """A chain whose ends are not similar is one group; a line that all texts have makes none, common or not."""
    monkeypatch.setattr(similar, "COMMON", common)
    monkeypatch.setattr(similar, "CELL", 6)
    prepare(spark)
    line = "one line that stands in all of these texts and says nothing of them"
    rows = [(i, f"{line} " + " ".join(f"w{i}x{k}" for k in range(30))) for i in range(40)]
    rows += [(100 + i, " ".join(f"c{k}" for k in range(6 * i, 6 * i + 100))) for i in range(8)]
    rows += [(200, ""), (201, None), (202, "a b"), (203, "A  b"), (None, "a b"), (None, "no id here")]
    found = spark.createDataFrame(rows, "doc_id long, text string")
    want = kept([r for r in rows if r[0] is not None])
    assert [i for i in want if i >= 100] == [100, 200, 202]
    got = sorted((r.doc_id for r in similar.distinct_documents(found).collect()), key=repr)
    assert got == sorted([*want, None], key=repr)


def test_edges(spark, monkeypatch):
    """Empty tables, repeated rows and ids, columns with the names used inside, a very long text, pairs in blocks and without broadcasts."""
    monkeypatch.setattr(similar, "BLOCK", 2)
    monkeypatch.setattr(similar, "BROADCAST_PLACES", 3)
    prepare(spark)
    long = " ".join(f"w{i % 9_973}" for i in range(40_000))
    rows = [(1, long), (1, long), (2, long + " and a few more words"), (3, None), (4, " \t"), (5, "x"), (5, "other text of five words"), (None, "x"), (6, "X")]
    rows += [(20 + i, " ".join(f"v{k}" for k in range(60)) + f" t{i}") for i in range(12)]
    names = ["fp", "h", "a", "b", "block", "set", "size", "hash", "raw", "component", "component_id", "lead", "hub"]
    df = spark.createDataFrame([(*r, *["mine"] * len(names)) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = similar.distinct_documents(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 5, 20]
    assert similar.distinct_documents(df.limit(0)).count() == 0


def test_large_bundles_in_blocks(spark, monkeypatch):
    """Near copies around the threshold, more than a block holds, against brute force."""
    import random

    monkeypatch.setattr(similar, "CELL", 20)
    prepare(spark)
    rng = random.Random(8)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(0, 7)):
            words[rng.randrange(150)] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    found = spark.createDataFrame(rows, "doc_id long, text string")
    want = kept(rows)
    assert 1 < len(want) < 100
    assert sorted(r.doc_id for r in similar.distinct_documents(found).collect()) == want

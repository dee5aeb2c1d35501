"""Near-dedup of rows without an id: they link like any other, in every way in which pairs are compared."""

import corpus_pipeline
from tidemark.llm import similar
from tidemark.llm.common import prepare


def text(name, change):
    words = [f"{name}{k}" for k in range(80)]
    return " ".join([*words[:change], f"x{change}", *words[change + 1:]]) if change else " ".join(words)


def test_near_copies_without_ids_go(spark, monkeypatch):
    monkeypatch.setattr(similar, "CELL", 3)
    monkeypatch.setattr(similar, "BROADCAST_PLACES", 3)
    prepare(spark)
    rows = [(7, text("a", 0)), *[(None, text("a", c)) for c in (1, 2, 78, 79)]]  # one with an id, four without
    rows += [(None, text("b", c)) for c in (0, 1, 2, 79)] + [(None, text("b", 1))] * 40  # none has an id, one text many times
    rows += [(0, text("c", 0)), (None, text("d", 0)), (None, None), (None, ""), (3, text("d", 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.simhash_stage(spark, docs, "").collect()]
    # The texts d share 71 of 81 shingles, the middle ones differ.
    assert sorted(i for i, _ in kept if i is not None) == [0, 3, 7]
    nameless = [t or "" for i, t in kept if i is None]
    assert len(nameless) == 2 and "" in nameless and sum(t.count("b") > 70 for t in nameless) == 1

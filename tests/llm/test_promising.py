"""Pairs that their leading shingles rule out: never one that is similar, and their sets do not travel."""

import numpy as np
import pytest

from tidemark.llm import similar
from tidemark.llm.common import prepare


@pytest.mark.parametrize("n_common", [0, 40, 400])
def test_bound_is_never_below_what_sets_share(n_common):
    rng = np.random.default_rng(5)
    world = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, 400))
    common, seen = np.sort(rng.permutation(world)[:n_common]), 0
    for _ in range(400):
        a = np.sort(rng.permutation(world)[:rng.integers(0, 120)])
        b = np.sort(np.union1d(rng.permutation(a)[:rng.integers(0, len(a) + 1)], rng.permutation(world)[:rng.integers(0, 60)]))
        leads = [(similar.leading(s, 0.8, common), len(s)) for s in (a, b)]
        shared, most = len(np.intersect1d(a, b)), similar.most_in_common(*leads, common)
        assert (shared <= most or not len(a) or not len(b)) and most == similar.most_in_common(*leads[::-1], common)
        seen += shared / max(1, len(a) + len(b) - shared) < 0.8 <= most / max(1, len(a) + len(b) - most)
    assert seen < 100


def test_pairs_that_share_a_line_do_not_send_their_sets(spark, monkeypatch):
    """Texts that only share a line meet in its cells; their leading shingles say that they are not similar."""
    prepare(spark)
    line = " ".join(f"l{k}" for k in range(8))
    rows = [(i, f"{line} " + " ".join(f"w{i}x{k}" for k in range(40))) for i in range(30)]
    rows += [(100 + i, " ".join(f"c{k}" for k in range(i, 60 + i))) for i in range(4)]
    sent, original = [], similar.linked
    monkeypatch.setattr(similar, "linked", lambda pairs, *rest: (sent.append(pairs.count()), original(pairs, *rest))[1])
    found = similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    groups = {r.doc_id: r.component_id for r in found.collect()}
    assert groups == {**{i: i for i in range(30)}, **{100 + i: 100 for i in range(4)}}
    assert sum(sent) <= 6

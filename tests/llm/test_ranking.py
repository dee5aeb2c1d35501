"""Block-Max MaxScore against scoring every document."""

import math
import os
import random
import re

import numpy as np
import pytest

from tidemark.llm import ranking
from tidemark.llm.common import prepare, table
from tidemark.session import cut_lineage

DATA = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=10):
    """(key, rank, doc_id, score) by the formula, one document after the other."""
    held = [(d, terms(t)) for d, t in docs]
    n_docs, total = sum(bool(t) for _, t in held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for key, text in items:
        scored = []
        for d, t in held:
            m = 25 + 75 * len(t) * n_docs // total if total else 0
            score = 0
            for x in terms(text):
                if x in df and x in t:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1)))
                    tf = t.count(x)
                    score += w * (1000000000 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(key, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def searched(spark, docs, items, parts=3):
    prepare(spark)
    d = spark.createDataFrame(docs, "doc_id long, text string, rank int, term string").repartition(parts)
    q = spark.createDataFrame(items, "item_id long, text string")
    found = ranking.search(cut_lineage(ranking.build_index(d)), q)
    return sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_random_documents(spark, monkeypatch):
    """Many shards, many blocks and ranges, ties and repeated rows."""
    for name, value in (("BLOCK", 4), ("SHARD_DOCS", 60), ("RANGE", 16)):
        monkeypatch.setattr(ranking, name, value)
    rng = random.Random(5)
    vocabulary = [f"w{i}é" if i % 3 else f"W{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    docs = [(i // 2 if i % 10 else i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(0, 30))), 1, "x") for i in range(400)]
    docs += [(None, "w1é w2é W0", 1, "x"), (7, None, 1, None), (8, "", None, "x"), (9, "w1é " * 5000, 1, "x")]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 12)))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "unknown words"), (103, "w1é w1é W0"), (103, "W0")]
    assert searched(spark, docs, items) == brute([d[:2] for d in docs], items)


def test_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == []
    assert searched(spark, [(1, "a", 1, "x")], []) == []
    assert searched(spark, [(1, "...", 1, "x")], [(1, "...")]) == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not present")
def test_query_on_the_tables(spark):
    prepare(spark)
    docs, items = table(spark, DATA, "documents"), table(spark, DATA, "benchmark")
    found = sorted((tuple(r) for r in ranking.op11(spark, DATA).select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    assert found == brute(docs.select("doc_id", "text").collect(), items.select("item_id", "text").collect())


def test_blocks_are_rejected_before_they_are_unpacked(monkeypatch):
    """A list that most documents have is opened only where a candidate may still enter."""
    monkeypatch.setattr(ranking, "RANGE", 1024)
    rng = np.random.default_rng(3)
    shard = ranking.Shard()
    for i in range(20_000):
        rare = b" rare" * (i % 2000 < 20)
        shard.add(i, b"common " * int(rng.integers(1, 4)) + b"filler " * int(rng.integers(5, 50)) + rare)
    rows = [r for batch in shard.rows(0) for r in batch.to_pylist()]
    lengths = np.array(rows[0]["lengths"], np.int64)
    norm = lambda x: 8 * (25 + 75 * x * len(lengths) // int(lengths.sum()))
    lists = {r["term"]: ranking.Postings(r, norm) for r in rows[1:]}
    weights = {t: math.floor(1000 * math.log((2 * 20_000 + 2) / (2 * sum(len(p.block(i, norm(lengths))[0]) for i in range(len(p.last))) + 1)))
               for t, p in lists.items()}
    for p in lists.values():
        p.kept.clear()
    weights[b"common"] = 50
    ids = np.arange(len(lengths))
    docs, scores = ranking.search_shard([(weights[t], lists[t]) for t in (b"rare", b"common")], norm(lengths), ids)
    total = np.zeros(len(lengths), np.int64)
    for t in (b"rare", b"common"):
        for i in range(len(lists[t].last)):
            where, gain = ranking.Postings.block(lists[t], i, norm(lengths)) if t == b"rare" else (
                lambda d, tf: (d, ranking.impact(tf, norm(lengths)[d])))(*ranking.unpack(lists[t].packed, lists[t].start[i], lists[t].start[i + 1]))
            total[where] += weights[t] * gain
    order = np.lexsort((ids, -total))[:10]
    assert sorted(zip(docs.tolist(), scores.tolist())) == sorted(zip(order.tolist(), total[order].tolist()))
    assert len(lists[b"common"].kept) < len(lists[b"common"].last) // 2

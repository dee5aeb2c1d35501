"""Quality rules: measures against plain counting, cutoffs against exact binomial bounds."""

import math
import os
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality
from tidemark.llm.common import prepare, table

DATA = "/root/testdata/sf0.01"
WORD = re.compile("[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), n < 50 or 100 * len(inside) > 50 * n)


def test_measures(spark):
    prepare(spark)
    texts = [None, "", " \n\t ", "one", "a b c", "a b c a b c", "a a a a a a", "x y z " * 30, "l1 a\nl1 a\n \n \nl1 a \n", "é #$   b\x0cc|",
             "w " * 20_000, " ".join(f"w{i % 977}" for i in range(60_000)), "a b c d a b c e b c d f", "\n".join(["same line here"] * 40)]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, whole int")
    rows = quality.measures(df).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in rows] == [
        plain(t) for t in texts]
    assert all(r.whole == 5 for r in rows)


def test_binomial(spark):
    cases = [(0, 10, 0.1), (3, 50, 0.1), (4, 1000, 0.004), (9, 5000, 0.004), (700, 200_000, 0.004)]
    for k, n, p in cases:
        got = spark.range(1).select(quality.at_most(F.lit(k).cast("bigint"), F.lit(n).cast("bigint"), p)).first()[0]
        exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
                    for i in range(k + 1))
        assert got == pytest.approx(min(1.0, exact), rel=1e-6)


def corpus(spark, n=40_000):
    """Good documents of which one in a hundred has many symbols, bad ones that all do, in two languages."""
    rows, labels = [], []
    for i in range(n):
        good, symbols = i % 6 > 0, 9 if i % 6 == 0 or i % 700 == 1 else 0
        rows.append((i, "word " * 60 + "#" * symbols * 5 + f" w{i}", "en" if i % 5 else None, 1, False))
        labels.append((i, int(good), 1))
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string, n_lines int, kept boolean"),
            spark.createDataFrame(labels, "doc_id long, quality int, stratum int"))


def test_certified_cutoffs(spark):
    """Every cutoff of the library stands by a plain recomputation, and no stricter one does."""
    prepare(spark)
    base = quality.MOST_REPEATED
    rows, labels = corpus(spark)
    rows = rows.withColumn("text", F.regexp_replace("text", "word ", F.concat(F.lit("w"), F.col("doc_id").cast("string"), F.lit(" "))))
    measured = rows.select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), F.lit(False).alias("base_failed"),
                           (F.length("text") - F.length(F.translate("text", "#", ""))).alias("symbols"),
                           *[F.lit(0 if r != "short_words" else -5000).alias(r) for r in quality.LADDERS if r != "symbols"]).cache()
    got = {r.stratum: r for r in quality.thresholds(measured, labels).collect()}
    good = {r.doc_id: r.quality > 0 for r in labels.collect()}
    held = lambda i: zlib.crc32(f"holdout:{i}".encode()) % 2 == 0
    data = measured.select("doc_id", "stratum", "symbols").collect()
    tests, tried = 0, {}
    for stratum in {r.stratum for r in data}:
        for cut in quality.LADDERS["symbols"]:
            share = lambda h, g: [r.symbols > cut for r in data if r.stratum == stratum and held(r.doc_id) == h and good[r.doc_id] == g]
            a, b, hold = share(False, True), share(False, False), share(True, True)
            if sum(b) * len(a) > sum(a) * len(b):
                tests += 1
                tried.setdefault(stratum, []).append((cut, sum(hold), len(hold)))
    risk = quality.SETTINGS.total_risk / len(quality.LADDERS)
    for stratum, cuts in tried.items():
        passed = [c for c, k, n in cuts if sum(math.comb(n, i) * risk ** i * (1 - risk) ** (n - i) for i in range(k + 1)) <= 0.05 / tests]
        assert (got[stratum].cut_symbols if stratum in got else None) == (min(passed) if passed else None)
    assert base == 50 and any(r.cut_symbols is not None for r in got.values())


def test_edges(spark):
    prepare(spark)
    docs, labels = corpus(spark, 30)
    assert quality.judged(docs.limit(0), labels.limit(0)).count() == 0
    odd = docs.union(spark.createDataFrame([(None, None, None, 1, True), (3, "x", "en", 1, True)], docs.schema))
    rows = quality.judged(odd, labels.union(spark.createDataFrame([(None, 1, 1), (3, None, 1)], labels.schema))).collect()
    assert len(rows) == 32 and not any(r.kept for r in rows if r.doc_id is None)
    assert all(not r.base_failed or not r.kept for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not present")
def test_query_on_the_tables(spark):
    texts = {r.doc_id: r.text for r in table(prepare(spark), DATA, "documents").collect()}
    rows = quality.op13(spark, DATA).collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: tuple(r)[1:7] for r in rows} == {d: plain(t) for d, t in texts.items()}
    good = {r.doc_id for r in table(spark, DATA, "labels").where("quality = 1").collect()}
    sound = [r for r in rows if r.doc_id in good and not r.base_failed]
    assert sum(not r.kept for r in sound) <= 0.05 * len(sound)

"""Quality rules with risk-controlled thresholds; native columns only.

Five rules look at a document: the share of symbols, the share of repeated lines, the share of words in
repeated three-word windows, and the mean length of words on both sides.  Each rule has a ladder of cutoffs from
lenient to strict.  Labelled documents are split in two.  On the first part, every stratum (language)
orders the cutoffs of a rule; one that rejects a smaller share of bad than of good documents there is not
even tried.  On the second part, the holdout, a cutoff stands if an exact binomial test rules out that it
rejects more than ``risk`` of the good documents of its stratum: the probability of so few rejections,
if the true share were ``risk``, is at most ``doubt`` divided by all tests that are made (Bonferroni over
strata, rules and cutoffs).  The strictest cutoff that stands is used; where none stands, the rule
rejects nothing.  Rules share the risk, so that all together reject at most ``total_risk``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, table, unused
from tidemark.llm.registry import query
from tidemark.session import cut_lineage

SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: Fixed values of the base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50


@dataclass(frozen=True)
class Settings:
    total_risk: float = 0.02  # share of the good documents of a stratum that all rules together may reject
    doubt: float = 0.05  # probability that any cutoff breaks its bound


SETTINGS = Settings()
#: Strata with cutoffs that travel to the rows by broadcast; more than that are many enough to shuffle by.
BROADCAST_STRATA = 100_000
#: Cutoffs of every rule from lenient to strict: a document fails where its measure is above, for ``short_words`` below.
LADDERS = {
    "symbols": (300, 200, 150, 100, 75, 50, 40, 30, 20, 15, 10, 5),
    "lines": (800, 600, 500, 400, 300, 250, 200, 150, 100, 75, 50, 25),
    "repeats": (450, 400, 350, 300, 250, 200, 150, 100, 75, 50, 25, 10),
    "long_words": (30_000, 20_000, 15_000, 12_000, 10_000, 9_000, 8_000, 7_500, 7_000, 6_500, 6_000, 5_500),
    "short_words": (1_000, 1_250, 1_500, 1_750, 2_000, 2_250, 2_500, 2_750, 3_000, 3_250, 3_500, 3_750),
}


def repeated_words(words: Column) -> Column:
    """Words inside a three-word window that the text holds twice or more.

    Windows are compared by hash and then word by word.  Only texts in which two hashes agree are sorted.
    """
    n = F.size(words)

    def window(i: Column) -> Column:
        return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    hashes = F.transform(F.sequence(F.lit(0), n - 3), window)
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def same(a: Column, b: Column) -> Column:
        equal = a["h"] == b["h"]
        return equal & reduce(lambda x, y: x & y, [F.get(words, a["i"] + k) == F.get(words, b["i"] + k) for k in range(3)])

    def starts(sorted_windows: Column) -> Column:
        def twice(x: Column, i: Column) -> Column:
            before, after = F.get(sorted_windows, i - 1), F.get(sorted_windows, i + 1)
            return F.coalesce(same(x, before), F.lit(False)) | F.coalesce(same(x, after), F.lit(False))

        return F.array_sort(F.transform(F.filter(sorted_windows, twice), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        begin = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(at, begin, lambda acc, i: F.struct(
            (i + 3).alias("end"), (acc["n"] + i + 3 - F.greatest(acc["end"], i)).alias("n")), lambda acc: acc["n"])

    # A lambda over a list of one keeps what it is given, so that nothing inside is worked out again.
    def once(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    counted = once(placed, lambda p: once(starts(p), covered))
    some = once(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(n < 4, F.lit(0)).when(some, counted).otherwise(F.lit(0)).cast("long")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs) and base_failed.

    Nothing is shuffled.  Null texts count as empty and fail; columns of those names are replaced.
    """
    whole, words = unused(docs, "whole"), unused(docs, "words")
    rows = docs.withColumn(whole, F.coalesce(F.col(text), F.lit("")))
    rows = rows.withColumn(words, F.regexp_extract_all(F.col(whole), F.lit(f"({WORD})"), F.lit(1)))
    lines = F.filter(F.split(F.col(whole), "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    n_chars = F.length(F.col(whole))
    n_words, repeats = F.size(words).cast("long"), repeated_words(F.col(words))
    found = {
        "n_words": n_words, "word_chars": F.length(F.translate(F.col(whole), SPACES, "")).cast("long"),
        "n_symbols": (n_chars - F.length(F.translate(F.col(whole), SYMBOLS, ""))).cast("long"),
        "n_dup_lines": F.get(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), F.lit(0)).cast("long"),
        "n_repeat_words": repeats,
    }
    rows = rows.withColumns(found).drop(whole, words)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def per_mille(part: str, whole: str) -> Column:
    return F.expr(f"CASE WHEN {whole} > 0 THEN {part} * 1000 DIV {whole} ELSE 0 END")


def rule_values() -> dict[str, Column]:
    """The measure of every rule as a whole number."""
    return {
        "symbols": per_mille("n_symbols", "word_chars"), "lines": per_mille("n_dup_lines", "n_lines"),
        "repeats": per_mille("n_repeat_words", "n_words"), "long_words": per_mille("word_chars", "n_words"),
        "short_words": -per_mille("word_chars", "n_words"),
    }


def at_most(k: Column, n: Column, share: float) -> Column:
    """P(X <= k) of n draws that each hit with probability ``share``: the sum of its exact terms, by their logarithms.

    Above the mean, where no test passes, the answer is 1.
    """
    odds = F.lit(share / (1 - share))
    first = F.struct((n * F.log1p(F.lit(-share))).alias("term"), F.exp(n * F.log1p(F.lit(-share))).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i * odds)
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    exact = F.least(F.lit(1.0), F.aggregate(steps, first, step, lambda acc: acc["sum"]))
    return F.when(k > n * share, F.lit(1.0)).otherwise(exact)


def in_holdout(doc_id: str) -> Column:
    return F.pmod(F.crc32(F.concat(F.lit("holdout:"), F.col(doc_id).cast("string")).cast("binary")), F.lit(2)) == 0


def thresholds(measured: DataFrame, labels: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """(stratum, one nullable cutoff per rule): the strictest cutoffs that the holdout certifies.

    ``measured`` has doc_id, stratum, base_failed and the rules' values; documents that fail the base rules
    are not among those whose rejection is bounded.  Rows without a label, with a null id or null
    label take no part; of several labels of a document the lowest counts, repeated rows count once.
    Without labels there are no rows.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    known = known.select(F.col("doc_id").alias("l_id"), "good")
    rows = measured.where(~F.col("base_failed")).join(known, F.col("doc_id") == F.col("l_id")).groupBy("doc_id", "good").agg(
        F.min(F.struct("stratum", *LADDERS)).alias("x")).select("doc_id", "good", "x.*").withColumn("held", in_holdout("doc_id"))
    # Counts of rejected documents by stratum, part and label, one column per rule and cutoff: map-side sums.
    counts = {f"{rule}_{i}": F.count_if(F.col(rule) > (-cut if rule == "short_words" else cut)) for rule, cuts in LADDERS.items() for i, cut in enumerate(cuts)}
    sums = rows.groupBy("stratum", "held", "good").agg(F.count("*").alias("n"), *[c.alias(n) for n, c in counts.items()])
    steps = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("step"), F.lit(cut).alias("cut"), F.col(f"{rule}_{i}").alias("k"))
                      for rule, cuts in LADDERS.items() for i, cut in enumerate(cuts)])
    tall = sums.select("stratum", "held", "good", "n", F.inline(steps))

    def part(name: str, held: bool, good: bool) -> list[Column]:
        mine = (F.col("held") == held) & (F.col("good") == good)
        return [F.coalesce(F.max(F.when(mine, F.col(c))), F.lit(0)).cast("bigint").alias(f"{name}_{c}") for c in ("k", "n")]

    tried = tall.groupBy("stratum", "rule", "step", "cut").agg(*part("good", False, True), *part("bad", False, False), *part("hold", True, True))
    useful = tried.where("bad_k * good_n > good_k * bad_n")
    useful = cut_lineage(useful.select("stratum", "rule", "step", "cut", "hold_k", "hold_n"))
    tests, risk = max(1, useful.count()), settings.total_risk / len(LADDERS)
    passed = useful.withColumn("p", at_most(F.col("hold_k"), F.col("hold_n"), risk)).where(
        (F.col("hold_n") > 0) & (F.col("p") <= settings.doubt / tests))
    return passed.groupBy("stratum").agg(*[F.max_by("cut", F.when(F.col("rule") == r, F.col("step"))).alias(f"cut_{r}") for r in LADDERS])


def judged(docs: DataFrame, labels: DataFrame, settings: Settings = SETTINGS, stratum: str = "lang") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row.

    A document is kept if it fails neither the base rules nor a certified cutoff of its stratum; a null
    stratum is one of its own, strata without labels reject nothing.  Repeated rows come back as often
    as they occur, rows with null ids are judged like any other, extra columns are left behind.
    """
    whole = F.coalesce(F.col("text"), F.lit(""))
    lines = F.size(F.filter(F.split(whole, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = docs.select("doc_id", "text", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), lines.alias("n_lines"))
    found = cut_lineage(measures(rows).select("doc_id", "stratum", *base, "n_lines"))
    valued = found.select("*", *[c.alias(name) for name, c in rule_values().items()])
    # Few rows: a stratum needs hundreds of labelled documents before a cutoff can be certified.
    cuts = cut_lineage(thresholds(valued, labels, settings).withColumnRenamed("stratum", "c_stratum"))
    cuts = F.broadcast(cuts) if cuts.count() <= BROADCAST_STRATA else cuts
    fails = [F.coalesce(F.col(r) > (-F.col(f"cut_{r}") if r == "short_words" else F.col(f"cut_{r}")), F.lit(False)) for r in LADDERS]
    rejected = reduce(lambda a, b: a | b, fails)
    ruled = valued.join(cuts, F.col("stratum") == F.col("c_stratum"), "left")
    return ruled.select("doc_id", *base, (~F.col("base_failed") & ~rejected).alias("kept"))


@query("op13_quality")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Exact grouped quantiles without holding a group in one task, and the quantile baseline.

Spark's ``percentile`` keeps every distinct value of a group in one aggregation buffer.  A group
here can be a whole platform, so the exact quantile is found by rank instead:

1. equal values combine into (group, value, count) before anything is ranked;
2. a monotone log-scale bin of the value gives (group, bin, count) totals, a few thousand per group;
3. running totals over the bins locate the one or two bins holding each wanted rank;
4. a located bin of many distinct values is cut into equal parts between its ends, of which again only those
   that hold a wanted rank stay, until every one is small;
5. only the values of those bins are ranked, in windows keyed by (group, bin).

All steps are hash shuffles that combine on the map side, so a platform with a third of the rows
costs no more than the others.

Quantiles of growing prefixes (the training rows of rolling-origin folds) are read from the same counts:
a value is counted under the first prefix that holds it, and the bins' counts are added up over the
prefixes.  No row is copied per prefix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

BINS_PER_E_FOLD = 400.0  # 0.25 % wide bins
OFFSET = 1_000_000       # separates negative, zero and positive bins
BROADCAST_SEGMENTS = 100_000
#: A bin of more distinct values than this is cut into this many parts before its values are ranked.
CROWDED, PARTS = 50_000, 4_096


def _bin(v: Column) -> Column:
    """Integer bin that never decreases with the value."""
    size = F.floor(F.log(F.abs(v)) * BINS_PER_E_FOLD).cast("bigint") + OFFSET
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0).cast("bigint"))


def _value_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    return cut_lineage(counted.withColumn("_bin", F.array(_bin(F.col("_v")))))


def _sized(counts: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Rows, distinct values and ends of every bin."""
    return counts.groupBy(*keys, "_bin").agg(
        F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_d"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), *more)


def _holding(bins: DataFrame) -> DataFrame:
    """The bins that hold rank floor(at) or ceil(at) (0-based) of a wanted quantile; ``_below`` rows come before the bin."""
    return bins.withColumn("_want", F.filter("_want", lambda q: (
        (F.ceil(q["at"]) >= F.col("_below")) & (F.floor(q["at"]) < F.col("_below") + F.col("_n"))
    ))).filter(F.size("_want") > 0)


def _located(bins: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """The bins of a group that hold its wanted ranks."""
    ordered = Window.partitionBy(*keys).orderBy("_bin")
    totals = bins.withColumn("_below", F.sum("_n").over(ordered) - F.col("_n")).withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
    wanted = F.array(*[
        F.struct(F.lit(name).alias("name"), (F.lit(float(p)) * (F.col("_total") - 1)).alias("at")) for name, p in probs.items()
    ])
    return _holding(totals.withColumn("_want", wanted)).select(*keys, "_bin", "_n", "_d", "_lo", "_hi", "_below", "_want")


def _read(counts: DataFrame, needed: DataFrame, keys: list[str], probs: dict[str, float], match: Column | None = None) -> DataFrame:
    """Quantiles from the values of the located bins; ``match`` says which values of a bin count for a group."""
    held = ["_lo", "_hi", "_d", "_below", "_want"]
    shared = [k for k in keys if k in counts.columns] + ["_bin"]
    parts = None
    while True:
        needed = cut_lineage(needed.select(*keys, "_bin", *held))
        joined = counts.join(needed, shared) if match is None else counts.join(needed, shared).filter(match)
        small = joined.filter(F.col("_d") <= CROWDED).select(*keys, "_bin", "_v", "_c", "_below", "_want")
        parts = small if parts is None else parts.unionByName(small)
        if needed.filter(F.col("_d") > CROWDED).isEmpty():
            break
        part = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * PARTS), F.lit(PARTS - 1)).cast("bigint")
        counts = cut_lineage(joined.filter(F.col("_d") > CROWDED).withColumn("_bin", F.concat("_bin", F.array(part))).select(
            *keys, "_bin", "_v", "_c", "_below", "_want"))
        shared, match = [*keys, "_bin"], None
        inside = Window.partitionBy(*keys, F.slice("_bin", 1, F.size("_bin") - 1)).orderBy("_bin")
        sized = _sized(counts, keys, F.first("_below").alias("_below"), F.first("_want").alias("_want"))
        needed = _holding(sized.withColumn("_below", F.col("_below") + F.sum("_n").over(inside) - F.col("_n")))
        counts = counts.select(*keys, "_bin", "_v", "_c")
    # By rows: a value may occur under several prefixes.
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        parts.withColumn("_end", F.col("_below") + F.sum("_c").over(inside))
        .withColumn("_start", F.col("_end") - F.col("_c"))
        .select(*keys, "_v", "_start", "_end", F.explode("_want").alias("_q"))
    )
    covers_low = F.floor("_q.at").between(F.col("_start"), F.col("_end") - 1)
    covers_high = F.ceil("_q.at").between(F.col("_start"), F.col("_end") - 1)
    aggs = []
    for name in probs:
        mine = F.col("_q.name") == name
        low = F.max(F.when(mine & covers_low, F.col("_v")))
        high = F.max(F.when(mine & covers_high, F.col("_v")))
        share = F.max(F.when(mine, F.col("_q.at") - F.floor("_q.at")))
        aggs.append((low + (high - low) * share).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """One row per group, one column per entry of ``probs``; linear interpolation between ranks."""
    counts = _value_counts(df, by, value)
    return _read(counts, _located(_sized(counts, by), by, probs), by, probs)


def prefix_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float], first: str, steps: int, step: str) -> DataFrame:
    """``exact_quantiles`` of every group for each prefix 0 .. steps - 1 (column ``step``) of its rows.

    ``first`` numbers the first prefix that holds a row; all later ones hold it too.
    """
    counts = _value_counts(df.filter(F.col(first) < steps), [*by, first], value)
    bins = _sized(counts, [*by, first]).groupBy(*by, "_bin").agg(F.collect_list(F.struct(first, "_n", "_d", "_lo", "_hi")).alias("_by_first"))
    # A bin has an entry per prefix at most, and becomes a row for each prefix from its first on.
    numbered = bins.withColumn(step, F.explode(F.sequence(F.array_min(F.transform("_by_first", lambda x: x[first])), F.lit(steps - 1))))
    until = numbered.withColumn("_in", F.filter("_by_first", lambda x: x[first] <= F.col(step)))
    total = lambda c: F.aggregate("_in", F.lit(0).cast("bigint"), lambda a, x: a + x[c])
    summed = until.select(*by, step, "_bin", total("_n").alias("_n"), total("_d").alias("_d"),
                          F.array_min(F.transform("_in", lambda x: x["_lo"])).alias("_lo"), F.array_max(F.transform("_in", lambda x: x["_hi"])).alias("_hi"))
    keys = [*by, step]
    return _read(counts, _located(summed, keys, probs), keys, probs, match=F.col(first) <= F.col(step))


def repair_quantiles(df: DataFrame) -> DataFrame:
    """No crossings (P10 and P90 give way to P50), no negative revenue."""
    floor = F.lit(0.0)
    return df.withColumns({
        "p10": F.greatest(F.least("p10", "p50"), floor),
        "p50": F.greatest("p50", floor),
        "p90": F.greatest(F.greatest("p90", "p50"), floor),
    })


def baseline_quantiles(df: DataFrame, by: list[str], value: str = "revenue_attributed") -> DataFrame:
    """Empirical P10 / P50 / P90 per segment: the model-free forecast."""
    return exact_quantiles(df, by, value, {"p10": 0.1, "p50": 0.5, "p90": 0.9})


def apply_baseline(df: DataFrame, quantiles: DataFrame, by: list[str]) -> DataFrame:
    """Score rows with segment quantiles.

    The quantiles are stored and counted first.  Up to ``BROADCAST_SEGMENTS`` rows of three numbers go
    to the rows by broadcast, so that these are not shuffled by a handful of segments; more segments
    than that are many enough to shuffle by.
    """
    stored = cut_lineage(quantiles.select(*by, "p10", "p50", "p90"))
    few = stored.count() <= BROADCAST_SEGMENTS
    return repair_quantiles(df.join(F.broadcast(stored) if few else stored, by, "left"))


@dataclass
class SegmentQuantiles:
    """The model-free forecast as a model: quantiles of the training rows by segment."""

    quantiles: DataFrame
    by: list[str]

    @staticmethod
    def fit(train: DataFrame, by: list[str], value: str = "revenue_attributed") -> SegmentQuantiles:
        return SegmentQuantiles(cut_lineage(baseline_quantiles(train, by, value)), by)

    def predict(self, df: DataFrame) -> DataFrame:
        """All input columns plus p10, p50, p90; NULL where the segment was not seen."""
        return apply_baseline(df, self.quantiles, self.by)

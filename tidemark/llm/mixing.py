"""Mixing sources to target weights, in native columns and joins only.

The words of a source, its documents one after the other in the order of a hash, are packed into
blocks of ``BLOCK`` words.  Each output shard draws how many of its slots go to each source: a
multinomial draw over equal strata, which has the same mean and less variance.  A source's slots,
numbered over all shards, go through a pseudorandom permutation of its block numbers, and blocks
join the slots by number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, table, unused
from tidemark.llm.registry import query
from tidemark.session import cut_lineage

BLOCK = 32
#: Slots of a shard, and the number of shards beyond which shards hold more slots instead.
SHARD_SLOTS, MOST_SHARDS = 1_024, 100_000
WEIGHTS = (5, 2, 1)
SHARE, REPEATS = 1.5, 2
SEED = "mix"
#: Sources up to which their table, of a few numbers each, is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 100_000
#: Multipliers of permutations stay below this, so that products of block numbers fit a long.
MULTIPLIER = 4_194_304


def hash32(*parts: Column | str) -> Column:
    """The first 32 bits of an MD5 over the parts; null parts count as empty."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size): words of every whole text, none in a null."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, sid, source_size, target): sources in code-point order, null last, with the words wanted of each.

    Weights repeat over the sources.  A target that would pass ``repeats`` times its source stays
    there; the level at which the others share the rest by weight follows from running sums over the
    sources by how soon they fill up.  One row per source goes through these windows, no document.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("sid", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("double")
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(repeats))
    filling = everything.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.select(
        "*", F.row_number().over(filling).alias("at"),
        ((F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
         / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))).alias("level"))
    open_at = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("at"))
    ranked = ranked.withColumn("first_open", F.min(open_at).over(everything))
    level = F.max(F.when(F.col("at") == F.col("first_open"), F.col("level"))).over(everything)
    target = F.when(F.col("at") < F.col("first_open"), F.col("cap")).otherwise(F.col("level_at") * F.col("weight"))
    return ranked.withColumn("level_at", level).select("source", "sid", "source_size", F.coalesce(target, "cap").alias("target"))


def permutations(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """``sources`` with their blocks, the slots they should get, and the permutation x -> (x * factor + shift) mod blocks.

    The factor is the first number from a hashed one on that shares no divisor with the blocks.
    """
    blocks = F.ceil(F.col("source_size") / block)
    some = F.greatest("blocks", F.lit(1))  # a source without words has no block

    def divisor(a: Column, b: Column) -> Column:
        pair = F.struct(a.alias("a"), b.alias("b"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(100)), pair, lambda p, _: F.when(p["b"] == 0, p).otherwise(
            F.struct(p["b"].alias("a"), (p["a"] % F.greatest(p["b"], F.lit(1))).alias("b"))), lambda p: p["a"])

    hashed = sources.withColumn("blocks", blocks).withColumns({
        "least": F.greatest(F.lit(1), hash32(SEED, "factor", F.col("sid")) % F.least(some, F.lit(MULTIPLIER))).cast("long"),
        "shift": (hash32(SEED, "shift", F.col("sid")) % some).cast("long"),
        "slots": F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0),
    })
    # No run of 128 numbers shares a divisor each with a number below 2^63.
    factor = F.filter(F.sequence("least", F.col("least") + 128), lambda x: divisor(x, F.col("blocks")) == 1)[0]
    upto = Window.partitionBy(F.lit(0)).orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    edges = hashed.withColumn("factor", factor).withColumn("upper", F.sum("slots").over(upto))
    return edges.withColumn("lower", F.coalesce(F.lag("upper").over(Window.partitionBy(F.lit(0)).orderBy("sid")), F.lit(0.0)))


def draws(perms: DataFrame, total: float) -> DataFrame:
    """(sid, blocks, factor, shift, shard, first, n): how many slots of each shard go to each source.

    A shard's slots are equal strata of the sources' line of shares, with one hashed point in each.
    The points below a source's edge are all in strata before it, and the edge's own where the
    point comes first.  ``first`` numbers a source's slots over the shards; those past ``REPEATS``
    rounds through its blocks are not used.
    """
    slots = max(1, round(total))
    shards = min(MOST_SHARDS, max(1, round(slots / SHARD_SLOTS)))

    def below(edge: str) -> Column:
        strata = F.col("strata")
        x = F.least(F.col(edge) / total * strata, strata.cast("double"))
        whole = F.floor(x)
        point = hash32(SEED, F.col("shard"), whole) / F.lit(4294967296.0)
        return whole + F.when((whole < strata) & (point < x - whole), 1).otherwise(0)

    drawn = perms.where("slots > 0").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    # The first shards hold one slot more where the slots do not divide evenly.
    drawn = drawn.withColumn("strata", F.lit(slots // shards) + F.when(F.col("shard") < slots % shards, 1).otherwise(0))
    drawn = drawn.withColumn("n", below("upper") - below("lower"))
    upto = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.withColumn("first", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    left = F.least(F.col("n"), F.col("blocks") * REPEATS - F.col("first"))
    return drawn.withColumn("n", left).where("n > 0").select("sid", "blocks", "factor", "shift", "shard", "first", "n")


def slots(drawn: DataFrame) -> DataFrame:
    """(sid, shard, slot, block): the block that each slot of the mix takes."""
    slot = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot")
    each = drawn.select("sid", "blocks", "factor", "shift", "shard", slot)
    block = ((F.col("slot") % F.col("blocks")) * F.col("factor") + F.col("shift")) % F.col("blocks")
    return each.select("sid", "shard", "slot", block.alias("block"))


def placed(sizes: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """(doc_id, sid, size, lo): where each document that has words begins in its source's line of words.

    Two running sums, over stretches of the hash order and within each, so that no task holds a source.
    """
    names = sources.select(F.col("source").alias("name"), "sid")
    rows = sizes.where("size > 0").join(F.broadcast(names) if few else names, F.col("source").eqNullSafe(F.col("name")))
    # As many stretches as a stretch has rows, so that neither window grows faster than the root of the rows.
    stretches = max(1, math.isqrt(sizes.count()))
    rows = rows.select("doc_id", "sid", "size", hash32(F.col("doc_id")).alias("u")).withColumn(
        "stretch", F.floor(F.col("u") * stretches / F.lit(4294967296.0)))
    sums = rows.groupBy("sid", "stretch").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("sid").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("sid").alias("s_sid"), F.col("stretch").alias("s_stretch"),
                       F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "stretch").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    run = rows.withColumn("lo", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    on = (F.col("sid") == F.col("s_sid")) & (F.col("stretch") == F.col("s_stretch"))
    return run.join(sums, on).select("doc_id", "sid", "size", (F.col("lo") + F.col("base")).alias("lo"))


def mixed(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row: the words of it that the mix takes, repeats counted.

    No document is taken more than ``REPEATS`` times.  Null texts and texts without words have size 0
    and are never taken; rows without a source form one of their own, last in order.  Rows with equal
    ids follow each other by size.  The draw depends on nothing but the rows, so reruns agree.
    """
    sizes = cut_lineage(sized(docs))
    sources = cut_lineage(permutations(targets(sizes), block))
    summary = sources.agg(F.count("*").alias("n"), F.sum("slots").alias("slots")).first()
    few = summary.n <= BROADCAST_SOURCES
    if summary.slots:
        times = slots(draws(sources, summary.slots)).groupBy("sid", "block").agg(F.count("*").alias("times"))
        hi = F.col("lo") + F.col("size")
        pieces = placed(sizes, sources, few).withColumn(
            "block", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((hi - 1) / block))))
        part = F.least(hi, (F.col("block") + 1) * block) - F.greatest(F.col("lo"), F.col("block") * block)
        found = pieces.withColumn("part", part).join(times, ["sid", "block"], "left")
        used = found.groupBy("sid", "lo", "doc_id", "size").agg(F.sum(F.col("part") * F.coalesce("times", F.lit(0))).alias("taken"))
        names = sources.select(F.col("sid").alias("s_sid"), "source", "source_size", "target")
        used = used.join(F.broadcast(names) if few else names, F.col("sid") == F.col("s_sid"))
        used = used.select("doc_id", "source", "size", "source_size", "target", "taken")
    else:
        used = sizes.limit(0).selectExpr("doc_id", "source", "size", "size AS source_size", "0D AS target", "size AS taken")
    names = sources.select(F.col("source").alias("name"), "source_size", "target")
    rest = sizes.where("size = 0").join(F.broadcast(names) if few else names, F.col("source").eqNullSafe(F.col("name")))
    return used.union(rest.select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))


def remixed(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, unchanged, each as often as the mix takes its words, rounded at random by a hash of its id.

    Rows without words carry no weight in a mix and stay as they are.
    """
    share = mixed(docs).groupBy("doc_id", "source", "size").agg((F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).alias("share"))
    names = [unused(docs, n) for n in ("mix_id", "mix_source", "mix_size", "mix_share", "own_size", "copy")]
    mix_id, mix_source, mix_size, mix_share, own_size, copy = names
    rows = docs.withColumn(own_size, F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long"))
    on = F.col("doc_id").eqNullSafe(F.col(mix_id)) & F.col("source").cast("string").eqNullSafe(F.col(mix_source)) & (
        F.col(own_size) == F.col(mix_size))
    point = hash32(SEED, "copies", F.col("doc_id")) / F.lit(4294967296.0)
    copies = F.when(F.col(own_size) == 0, 1).otherwise(F.floor(F.col(mix_share) + point)).cast("int")
    joined = rows.join(share.toDF(mix_id, mix_source, mix_size, mix_share), on)
    return joined.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), copies)).alias(copy)).drop(copy)


# The same draw in SQL.
SQL = f"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM totals
), weighted AS (
  SELECT *, CAST(CASE sid % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS cap FROM ranked
), filling AS (
  SELECT *, row_number() OVER w AS pos,
         (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighted WINDOW w AS (ORDER BY cap / weight, sid)
), opened AS (SELECT min(pos) AS first_open, min_by(level, pos) AS level_at FROM filling WHERE level <= cap / weight
), goals AS (
  SELECT source, sid, source_size, CASE WHEN pos < first_open THEN cap ELSE level_at * weight END AS target,
         CAST(ceil(source_size / {BLOCK}) AS BIGINT) AS blocks
  FROM filling, opened
), hashed AS (
  SELECT *, greatest(1, CAST(('0x' || substr(md5('{SEED}:factor:' || sid), 1, 8)) AS BIGINT) % least(blocks, {MULTIPLIER})) AS least_factor,
         CAST(('0x' || substr(md5('{SEED}:shift:' || sid), 1, 8)) AS BIGINT) % blocks AS shift,
         CASE WHEN source_size > 0 THEN target * blocks / source_size ELSE 0.0 END AS slots
  FROM goals
), perms AS (
  SELECT *, list_filter(range(least_factor, least_factor + 129), lambda x: gcd(x, blocks) = 1)[1] AS factor,
         sum(slots) OVER (ORDER BY sid) AS upper,
         coalesce(sum(slots) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS lower
  FROM hashed
), plan AS (
  SELECT sum(slots) AS total, CAST(greatest(1, round(sum(slots))) AS BIGINT) AS n_slots,
         CAST(least({MOST_SHARDS}, greatest(1, round(round(sum(slots)) / {SHARD_SLOTS}))) AS BIGINT) AS shards
  FROM perms
), strata AS (
  SELECT sid, blocks, factor, shift, upper, lower, total, s.shard,
         n_slots // shards + CASE WHEN s.shard < n_slots % shards THEN 1 ELSE 0 END AS strata
  FROM perms, plan, LATERAL (SELECT unnest(range(shards)) AS shard) s WHERE slots > 0
), edges AS (
  SELECT *, least(upper / total * strata, strata) AS xu, least(lower / total * strata, strata) AS xl FROM strata
), points AS (
  SELECT *, CAST(floor(xu) AS BIGINT) AS fu, CAST(floor(xl) AS BIGINT) AS fl FROM edges
), counts AS (
  SELECT *, fu + CASE WHEN fu < strata AND CAST(('0x' || substr(md5('{SEED}:' || shard || ':' || fu), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE < xu - fu THEN 1 ELSE 0 END
          - fl - CASE WHEN fl < strata AND CAST(('0x' || substr(md5('{SEED}:' || shard || ':' || fl), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE < xl - fl THEN 1 ELSE 0 END AS n
  FROM points
), numbered AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY sid ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
  FROM counts
), used_slots AS (
  SELECT sid, blocks, factor, shift, CAST(first AS BIGINT) AS first, CAST(least(n, blocks * {REPEATS} - first) AS BIGINT) AS n FROM numbered
), times AS (
  SELECT sid, ((slot % blocks) * factor + shift) % blocks AS block, count(*) AS times
  FROM (SELECT *, unnest(range(first, first + n)) AS slot FROM used_slots WHERE n > 0) GROUP BY 1, 2
), placed AS (
  SELECT s.doc_id, g.sid, s.size, g.source_size, g.target,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY g.sid ORDER BY substr(md5(CAST(s.doc_id AS VARCHAR)), 1, 8), s.doc_id, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lo
  FROM sizes s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
), pieces AS (
  SELECT *, unnest(CASE WHEN size > 0 THEN range(lo // {BLOCK}, (lo + size - 1) // {BLOCK} + 1) ELSE [-1] END) AS block FROM placed
)
SELECT p.doc_id, p.size, p.source_size, p.target,
       CAST(sum(CASE WHEN p.size > 0 THEN (least(p.lo + p.size, (p.block + 1) * {BLOCK}) - greatest(p.lo, p.block * {BLOCK})) * coalesce(t.times, 0) ELSE 0 END) AS BIGINT) AS taken
FROM pieces p LEFT JOIN times t ON p.sid = t.sid AND p.block = t.block
GROUP BY p.doc_id, p.sid, p.lo, p.size, p.source_size, p.target
"""


@query("op6_mixing", SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")

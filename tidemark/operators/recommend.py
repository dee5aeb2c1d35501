"""Budget recommendations from allocations or from curves alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import curves as C
from tidemark.functions import messages as M
from tidemark.functions.text import fill, fixed, percent, titled, whole

# --- fixed values: move limits ----------------------------------------------------------
MIN_MOVE = 10.0
MIN_MOVE_SHARE = 0.05
MIN_MROAS_GAP = 0.2
HIGH_LIFT_PCT = 5.0
PAIRS = 3
QUICK_STEP = 0.15
QUICK_MAX_SATURATION = 0.80
PRIORITIES = ["high", "medium", "low"]
# ---------------------------------------------------------------------------------------

RECORD = [
    "type", "priority", "title", "rationale", "expected_revenue_lift", "expected_revenue_lift_pct",
    "source_campaign_id", "target_campaign_id", "spend_change", "baseline_marginal_roas",
    "target_marginal_roas",
]


def _text(c: Column | None) -> Column:
    return (F.lit(None) if c is None else c).cast("string")


def from_allocations(alloc: DataFrame) -> DataFrame:
    """One increase or decrease per campaign whose move is worth making."""
    delta = F.col("spend_delta")
    worth = (F.abs(delta) >= MIN_MOVE) & (
        (F.col("baseline_spend") <= 0) | (F.abs(delta) >= F.col("baseline_spend") * MIN_MOVE_SHARE)
    )
    up = delta > 0
    name, ident = titled("platform"), F.col("campaign_id")
    amount = whole(F.abs(delta))
    pct = fixed("spend_delta_pct", 0)
    sat = F.col("saturation_at_optimal")
    return alloc.filter(worth).select(
        F.when(up, "increase_budget").otherwise("decrease_budget").alias("type"),
        F.when(up & (F.col("revenue_delta_pct") > HIGH_LIFT_PCT), "high").otherwise("medium").alias("priority"),
        F.when(up, fill(M.INCREASE_TITLE, platform=name, id=ident, amount=amount, pct=pct))
        .otherwise(fill(M.DECREASE_TITLE, platform=name, id=ident, amount=amount, pct=pct)).alias("title"),
        F.when(up, fill(M.INCREASE_TEXT, lift=whole("revenue_delta"), lift_pct=fixed("revenue_delta_pct"),
                        mroas=fixed("optimal_marginal_roas", 2), sat=percent(sat)))
        .otherwise(fill(M.DECREASE_TEXT, state=F.when(sat > 0.75, "saturated").otherwise("over-budgeted"),
                        amount=amount, lift_pct=fixed("revenue_delta_pct", signed=True))).alias("rationale"),
        F.col("revenue_delta").alias("expected_revenue_lift"),
        F.col("revenue_delta_pct").alias("expected_revenue_lift_pct"),
        _text(None).alias("source_campaign_id"),
        _text(ident).alias("target_campaign_id"),
        delta.alias("spend_change"),
        "baseline_marginal_roas",
        F.col("optimal_marginal_roas").alias("target_marginal_roas"),
    )


def _top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """First n rows with their rank; the ranking window only ever sees those n rows."""
    return df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def reallocation_pairs(moves: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """k-th largest decrease feeds the k-th best increase, when the marginal ROAS gap pays."""
    src = _top(moves.filter("type = 'decrease_budget'"),
               [F.abs("spend_change").desc(), F.col("target_campaign_id")], pairs).select(
        "rank", F.col("target_campaign_id").alias("src"), F.abs("spend_change").alias("freed"),
        F.col("baseline_marginal_roas").alias("src_mroas"),
        F.abs("expected_revenue_lift").alias("src_lift"),
        F.abs("expected_revenue_lift_pct").alias("src_lift_pct"),
    )
    dst = _top(moves.filter("type = 'increase_budget'"),
               [F.col("target_marginal_roas").desc(), F.col("target_campaign_id")], pairs).select(
        "rank", F.col("target_campaign_id").alias("dst"), F.col("spend_change").alias("wanted"),
        F.col("target_marginal_roas").alias("dst_mroas"),
        F.col("expected_revenue_lift").alias("dst_lift"),
        F.col("expected_revenue_lift_pct").alias("dst_lift_pct"),
    )
    t = (
        src.join(dst, "rank")
        .withColumn("amount", F.least("freed", "wanted"))
        .withColumn("lift", F.col("dst_lift") + F.col("src_lift"))
        .filter((F.col("dst_mroas") - F.col("src_mroas") >= MIN_MROAS_GAP) & (F.col("amount") >= MIN_MOVE))
    )
    source, target, amount = F.col("src"), F.col("dst"), whole("amount")
    return t.select(
        F.lit("reallocate").alias("type"),
        F.lit("high").alias("priority"),
        fill(M.MOVE_TITLE, amount=amount, source=source, target=target).alias("title"),
        fill(M.MOVE_TEXT, target=target, target_mroas=fixed("dst_mroas", 2), source=source,
             source_mroas=fixed("src_mroas", 2), amount=amount, lift=fixed("lift", 0)).alias("rationale"),
        F.col("lift").alias("expected_revenue_lift"),
        ((F.col("dst_lift_pct") + F.col("src_lift_pct")) / 2.0).alias("expected_revenue_lift_pct"),
        source.alias("source_campaign_id"),
        target.alias("target_campaign_id"),
        F.col("amount").alias("spend_change"),
        F.col("src_mroas").alias("baseline_marginal_roas"),
        F.col("dst_mroas").alias("target_marginal_roas"),
    )


def ranked(recs: DataFrame, top_n: int = 5) -> DataFrame:
    order = F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("priority"))
    return recs.orderBy(
        order, F.col("expected_revenue_lift").desc(), "type", "target_campaign_id"
    ).limit(top_n)


def recommendations(alloc: DataFrame, top_n: int = 5) -> DataFrame:
    moves = from_allocations(alloc)
    return ranked(moves.unionByName(reallocation_pairs(moves)), top_n)


def quick_recommendations(curves: DataFrame, top_n: int = 5) -> DataFrame:
    """Raise the three best and cut the three worst marginal returns by 15 %, without an optimizer."""
    spend, mroas = F.col("avg_daily_spend"), F.col("current_marginal_roas")
    step = spend * QUICK_STEP
    name, ident, sat = titled("platform"), F.col("campaign_id"), percent("saturation_score")
    best = curves.orderBy(mroas.desc(), "campaign_id").limit(PAIRS)
    worst = curves.orderBy(mroas.asc(), F.col("campaign_id").desc()).limit(PAIRS)

    raised = C.hill(spend + step)
    gain = raised - F.col("avg_daily_revenue")
    boost = best.filter((F.col("saturation_score") <= QUICK_MAX_SATURATION) & (step >= MIN_MOVE)).select(
        F.lit("increase_budget").alias("type"), F.lit("high").alias("priority"),
        fill(M.BOOST_TITLE, platform=name, id=ident, amount=whole(step)).alias("title"),
        fill(M.BOOST_TEXT, mroas=fixed(mroas, 2), sat=sat, lift=whole(gain)).alias("rationale"),
        gain.alias("expected_revenue_lift"),
        C.lift_pct(raised, "avg_daily_revenue").alias("expected_revenue_lift_pct"),
        _text(None).alias("source_campaign_id"), _text(ident).alias("target_campaign_id"),
        step.alias("spend_change"), mroas.alias("baseline_marginal_roas"),
        C.marginal_roas(spend + step).alias("target_marginal_roas"),
    )
    loss = C.hill(spend - step) - F.col("avg_daily_revenue")
    trim = worst.filter((spend >= MIN_MOVE * 2) & (step >= MIN_MOVE)).select(
        F.lit("decrease_budget").alias("type"), F.lit("medium").alias("priority"),
        fill(M.TRIM_TITLE, platform=name, id=ident, amount=whole(step)).alias("title"),
        fill(M.TRIM_TEXT, mroas=fixed(mroas, 2), sat=sat, lift=whole(loss)).alias("rationale"),
        loss.alias("expected_revenue_lift"),
        F.when(F.col("avg_daily_revenue") > 0, loss / F.col("avg_daily_revenue") * 100.0)
        .otherwise(F.lit(0.0)).alias("expected_revenue_lift_pct"),
        _text(ident).alias("source_campaign_id"), _text(None).alias("target_campaign_id"),
        (-step).alias("spend_change"), mroas.alias("baseline_marginal_roas"),
        F.lit(0.0).alias("target_marginal_roas"),
    )
    has_spend = curves.agg(F.sum("avg_daily_spend")).scalar() > 0
    return (
        boost.unionByName(trim).filter(has_spend)
        .orderBy(F.col("expected_revenue_lift").desc(), "title").limit(top_n)
    )

"""Aggregates behind the dashboard: forecasts, curves and scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import in_last, last_date, ratio0, total
from tidemark.functions.names import segment
from tidemark.functions.text import titled

# --- fixed values: bucket limits of the saturation score, display limits ----------------
SATURATED, HEADROOM = 0.75, 0.40
MIN_BUBBLE = 6.0
TOTAL_LABEL = "Total Change"
# ---------------------------------------------------------------------------------------


# ---- forecasts -------------------------------------------------------------------------


def fan_chart(fc: DataFrame) -> DataFrame:
    """P10 / P50 / P90 and actuals by day; days without actuals stay NULL."""
    return fc.groupBy("date").agg(
        F.sum("p10").alias("p10"), F.sum("p50").alias("p50"), F.sum("p90").alias("p90"),
        F.sum("revenue_attributed").alias("actual"),
    )


def platform_contribution(fc: DataFrame, platforms: list[str]) -> DataFrame:
    """P50 by day, one column per platform.  Naming the platforms spares the pivot a pre-scan."""
    return fc.groupBy("date").pivot("platform", platforms).agg(F.sum("p50")).fillna(0.0, platforms)


def forecast_kpis(fc: DataFrame, days: int = 7) -> DataFrame:
    recent = fc.filter(in_last("date", last_date(fc), days))
    return recent.agg(total("p10").alias("p10"), total("p50").alias("p50"), total("p90").alias("p90")).withColumn(
        "interval_width_pct", ratio0(F.col("p90") - F.col("p10"), "p50", 100.0)
    )


def leaderboard(fc: DataFrame, top_n: int = 10) -> DataFrame:
    return (
        fc.groupBy("campaign_id").agg(F.sum("p50").alias("p50"))
        .orderBy(F.col("p50").desc(), "campaign_id").limit(top_n)
    )


def raw_forecast_order(fc: DataFrame) -> DataFrame:
    return fc.orderBy(F.col("date").desc(), "campaign_id")


def union_future(history: DataFrame, future: DataFrame) -> DataFrame:
    return history.unionByName(future, allowMissingColumns=True)


# ---- curves ----------------------------------------------------------------------------


def portfolio_kpis(curves: DataFrame) -> DataFrame:
    return curves.agg(
        F.count(F.lit(1)).alias("n_campaigns"),
        total("avg_daily_spend").alias("total_daily_spend"),
        total("avg_daily_revenue").alias("total_daily_revenue"),
        F.count_if(F.col("saturation_score") >= SATURATED).alias("n_saturated"),
        F.count_if(F.col("saturation_score") < HEADROOM).alias("n_headroom"),
    ).withColumn("blended_roas", ratio0("total_daily_revenue", "total_daily_spend"))


def platform_comparison(curves: DataFrame) -> DataFrame:
    sums = curves.groupBy("platform").agg(
        F.count(F.lit(1)).alias("campaigns"),
        F.count_if("is_reliable").alias("reliable_curves"),
        F.sum("avg_daily_spend").alias("_spend"),
        F.sum("avg_daily_revenue").alias("_revenue"),
        F.avg("saturation_score").alias("_sat"),
        F.avg("current_marginal_roas").alias("_mroas"),
    )
    return sums.select(
        titled("platform").alias("platform"),
        "campaigns",
        "reliable_curves",
        F.round("_spend", 0).alias("daily_spend"),
        F.round("_revenue", 0).alias("daily_revenue"),
        F.round(ratio0("_revenue", "_spend"), 2).alias("roas"),
        F.round(F.col("_sat") * 100.0, 1).alias("avg_saturation_pct"),
        F.round("_mroas", 2).alias("avg_marginal_roas"),
    ).orderBy(F.col("daily_revenue").desc(), "platform")


def segment_table(curves: DataFrame, label: Column | str = "campaign_id") -> DataFrame:
    """TM / NTM comparison by platform.

    ``label`` is the text the segment is read from.  The default reproduces the id-based rule;
    pass "campaign_name" or an audience column for ids that carry no marker.
    """
    out = curves.withColumn("segment", segment(label)).groupBy("platform", "segment").agg(
        F.count(F.lit(1)).alias("campaigns"),
        F.sum("avg_daily_spend").alias("daily_spend"),
        F.sum("avg_daily_revenue").alias("daily_revenue"),
        F.avg("current_roas").alias("avg_roas"),
        F.avg("current_marginal_roas").alias("avg_marginal_roas"),
        F.avg("saturation_score").alias("avg_saturation"),
    )
    return out.withColumns({c: F.round(c, 2) for c in out.columns[3:]})


def forecast_revenue(fc: DataFrame, days: int = 7) -> DataFrame:
    """Windowed P50 per campaign."""
    return fc.filter(in_last("date", last_date(fc), days)).groupBy("campaign_id").agg(
        F.sum("p50").alias(f"forecast_rev_{days}d")
    )


def campaign_table(curves: DataFrame, fc: DataFrame | None = None, days: int = 7,
                   label: Column | str = "campaign_id") -> DataFrame:
    """Curve metrics with forecast revenue and segment, rounded for display."""
    out = curves.select(
        "campaign_id", "campaign_name", "platform",
        F.round("avg_daily_spend", 2).alias("avg_daily_spend"),
        F.round("avg_daily_revenue", 2).alias("avg_daily_revenue"),
        F.round("current_roas", 2).alias("current_roas"),
        F.round("current_marginal_roas", 2).alias("marginal_roas"),
        F.round(F.col("saturation_score") * 100.0, 1).alias("saturation_pct"),
        "is_reliable",
        F.round("r_squared", 2).alias("r_squared"),
        segment(label).alias("segment"),
    )
    return out if fc is None else out.join(forecast_revenue(fc, days), "campaign_id", "left")


# ---- scenarios and allocations -----------------------------------------------------------


def before_after(projections: DataFrame) -> DataFrame:
    return projections.groupBy("scenario", "platform").agg(
        F.sum("baseline_daily_revenue").alias("baseline"),
        F.sum("projected_daily_revenue").alias("projected"),
    )


def waterfall(projections: DataFrame) -> DataFrame:
    """Spend change by platform plus the total row, as one rollup."""
    out = projections.groupBy("platform").agg(
        F.sum("spend_delta").alias("spend_delta"),
        F.sum("baseline_daily_spend").alias("baseline"),
        F.sum("new_daily_spend").alias("new_spend"),
    )
    return out.rollup("platform").agg(
        F.grouping("platform").alias("_total"),
        F.sum("spend_delta").alias("spend_delta"),
        F.sum("baseline").alias("baseline"),
        F.sum("new_spend").alias("new_spend"),
    ).select(
        F.when(F.col("_total") == 1, TOTAL_LABEL).otherwise(titled("platform")).alias("label"),
        F.when(F.col("_total") == 1, "total").otherwise("relative").alias("measure"),
        "spend_delta", "baseline", "new_spend",
    )


def top_movers(projections: DataFrame, top_n: int = 15) -> DataFrame:
    moved = F.abs("spend_delta_pct")
    return (
        projections.select(
            "campaign_id", "platform", "baseline_marginal_roas", "new_marginal_roas",
            "spend_delta_pct", moved.alias("abs_delta"),
            F.greatest(moved, F.lit(MIN_BUBBLE)).alias("bubble_size"),
        )
        .orderBy(F.col("abs_delta").desc(), "campaign_id").limit(top_n)
    )


def allocation_display(allocations: DataFrame) -> DataFrame:
    """Moves above half a unit, best revenue lift first."""
    return (
        allocations.filter(F.abs("spend_delta") > 0.5)
        .select(
            "campaign_id", titled("platform").alias("platform"),
            F.round("baseline_spend", 0).alias("current_spend"),
            F.round("optimal_spend", 0).alias("optimal_spend"),
            F.round("spend_delta", 0).alias("spend_change"),
            F.round("spend_delta_pct", 1).alias("spend_change_pct"),
            F.round("revenue_delta", 0).alias("revenue_lift"),
            F.round("saturation_at_optimal", 2).alias("saturation"),
        )
        .orderBy(F.col("revenue_lift").desc(), "campaign_id")
    )


def projection_display(projections: DataFrame) -> DataFrame:
    return projections.select(
        "scenario", "campaign_id", titled("platform").alias("platform"),
        F.round("baseline_daily_spend", 0).alias("baseline_spend"),
        F.round("new_daily_spend", 0).alias("new_spend"),
        F.round("baseline_daily_revenue", 0).alias("baseline_revenue"),
        F.round("projected_daily_revenue", 0).alias("projected_revenue"),
        F.round("revenue_delta_pct", 1).alias("revenue_lift_pct"),
    ).orderBy("scenario", F.col("revenue_lift_pct").desc(), "campaign_id")

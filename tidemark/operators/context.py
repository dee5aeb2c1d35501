"""One-row portfolio summary and the nested JSON document built from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import ratio0, total
from tidemark.operators.insights import top_campaigns
from tidemark.operators.reports import HEADROOM, SATURATED
from tidemark.operators.series import two_periods
from tidemark.functions.exprs import in_last, last_date

# --- fixed values: list lengths and the low-utilization share ----------------------------
LIST_CAP, RECOMMENDATION_CAP, TOP_CAMPAIGNS = 10, 5, 5
LOW_UTILIZATION = 0.3
# ---------------------------------------------------------------------------------------


def _low(curves: DataFrame) -> Column:
    """Spend far below the portfolio's mean."""
    mean = curves.agg(F.avg("avg_daily_spend")).scalar()
    return F.coalesce(F.col("avg_daily_spend") < F.lit(LOW_UTILIZATION) * mean, F.lit(False))


def campaign_buckets(curves: DataFrame) -> DataFrame:
    """(campaign_id, bucket): every campaign that is saturated, has headroom or is little used; one row per bucket."""
    buckets = {"saturated": F.col("saturation_score") >= SATURATED, "has_headroom": F.col("saturation_score") < HEADROOM,
               "low_utilization": _low(curves)}
    named = F.array(*[F.when(c, F.lit(name)) for name, c in buckets.items()])
    return curves.select("campaign_id", F.explode(F.array_compact(named)).alias("bucket"))


def _leading_ids(buckets: DataFrame | None, bucket: str) -> Column:
    """The first ids of a bucket, for the document only; the cut happens before anything is collected."""
    if buckets is None:
        return F.array().cast("array<string>")
    few = buckets.filter(F.col("bucket") == bucket).select("campaign_id").orderBy("campaign_id").limit(LIST_CAP)
    return few.agg(F.array_sort(F.collect_list(F.col("campaign_id").cast("string")))).scalar()


def _platform_map(df: DataFrame, value: str) -> Column:
    """Sums by platform as a map; one entry per advertising platform."""
    sums = df.groupBy("platform").agg(F.round(F.sum(value), 2).alias("v"))
    return sums.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("platform", "v"))))).scalar()


def context_summary(fc: DataFrame, curves: DataFrame, allocation: DataFrame | None = None,
                    days: int = 7) -> DataFrame:
    """Totals, changes, maps and counts of the portfolio in one row; the campaigns counted are in ``campaign_buckets``."""
    recent = fc.filter(in_last("date", last_date(fc), days))
    change = two_periods(fc, "p50", days)
    # One pass over the curves gives everything about them.
    of_curves = curves.agg(F.struct(
        total("avg_daily_spend").alias("spend"), total("avg_daily_revenue").alias("revenue"),
        F.count_if(F.col("saturation_score") >= SATURATED).alias("saturated"),
        F.count_if(F.col("saturation_score") < HEADROOM).alias("headroom"), F.count_if(_low(curves)).alias("low"))).scalar()
    totals = recent.agg(total("p50").alias("total_p50"), total("p10").alias("total_p10"),
                        total("p90").alias("total_p90"))
    top = top_campaigns(fc, TOP_CAMPAIGNS, days)
    best_first = F.sort_array(F.collect_list(
        F.struct("revenue", F.col("campaign_id").cast("string").alias("campaign_id"), "share_pct")
    ), asc=False)
    top_list = top.agg(best_first.alias("l")).select(F.transform("l", lambda t: F.struct(
        t["campaign_id"].alias("campaign_id"), t["revenue"].alias("revenue"), t["share_pct"].alias("share_pct")
    ))).scalar()
    columns = {
        "revenue_wow_change_pct": change.select(ratio0(F.col("recent") - F.col("prior"), "prior", 100.0)).scalar(),
        "total_daily_spend": of_curves["spend"],
        "current_roas": ratio0(of_curves["revenue"], of_curves["spend"]),
        "revenue_by_platform": _platform_map(recent, "p50"),
        "spend_by_platform": _platform_map(curves, "avg_daily_spend"),
        "top_campaigns": top_list,
        "n_saturated": of_curves["saturated"],
        "n_headroom": of_curves["headroom"],
        "n_low_utilization": of_curves["low"],
    }
    for name, source in (("lift_pct", "revenue_lift_pct"), ("lift_abs", "revenue_lift"), ("risk_score", "risk_score")):
        columns[name] = F.lit(0.0) if allocation is None else allocation.select(source).scalar()
    return totals.withColumn("period_days", F.lit(days)).withColumns(columns)


def _records(df: DataFrame | None, fields: dict[str, Column | str], cap: int) -> Column:
    """First records of an already ordered table as an array of structs."""
    if df is None:
        return F.array()
    few = df.limit(cap).select(F.struct(*[
        (F.col(c) if isinstance(c, str) else c).alias(n) for n, c in fields.items()
    ]).alias("r"))
    return few.agg(F.collect_list("r")).scalar()


def context_json(summary: DataFrame, insights: DataFrame | None = None, risks: DataFrame | None = None,
                 recs: DataFrame | None = None, buckets: DataFrame | None = None) -> DataFrame:
    """The summary and the leading campaigns, insights, risks and recommendations as one JSON document."""
    def r(c, digits):
        return F.round(c, digits)

    doc = F.struct(
        F.struct(
            "period_days", r("total_p50", 2).alias("total_p50"), r("total_p10", 2).alias("total_p10"),
            r("total_p90", 2).alias("total_p90"), r("revenue_wow_change_pct", 2).alias("wow_change_pct"),
        ).alias("forecast"),
        F.struct(
            r("total_daily_spend", 2).alias("total_daily"), r("current_roas", 3).alias("current_roas"),
            F.col("spend_by_platform").alias("by_platform"),
        ).alias("spend"),
        F.col("revenue_by_platform"),
        F.col("top_campaigns"),
        F.struct(
            r("lift_pct", 2).alias("lift_pct"), r("lift_abs", 2).alias("lift_abs"),
            r("risk_score", 3).alias("risk_score"),
        ).alias("optimization"),
        F.struct(*[_leading_ids(buckets, b).alias(b) for b in ("saturated", "has_headroom", "low_utilization")]).alias("saturation"),
        _records(insights, {
            "type": "type", "severity": "severity", "title": "title", "metric": "metric_name",
            "value": r("metric_value", 3), "unit": "metric_unit",
        }, LIST_CAP).alias("insights"),
        _records(risks, {
            "type": "type", "severity": "severity", "title": "title", "metric": "metric_name",
            "value": r("metric_value", 3), "threshold": r("threshold", 3), "campaign": "campaign_id",
            "platform": "platform",
        }, LIST_CAP).alias("risks"),
        _records(recs, {
            "type": "type", "priority": "priority", "title": "title",
            "revenue_lift": r("expected_revenue_lift", 2), "lift_pct": r("expected_revenue_lift_pct", 2),
            "spend_change": r("spend_change", 2), "from_campaign": "source_campaign_id",
            "to_campaign": "target_campaign_id",
        }, RECOMMENDATION_CAP).alias("recommendations"),
    )
    return summary.select(F.to_json(doc).alias("context"))

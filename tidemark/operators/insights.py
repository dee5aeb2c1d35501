"""Insight tables: windowed comparisons of forecasts and facts against thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import messages as M
from tidemark.functions.exprs import in_last, last_date, ratio, total
from tidemark.functions.text import fill, fixed, titled, whole
from tidemark.operators.series import period_over_period, two_periods
from tidemark.roles import PANEL, Roles

# --- fixed values: thresholds and severity order ----------------------------------------
TREND_PCT = 5.0
SHARE_SHIFT_PP, SHARE_WARNING_PP = 3.0, 10.0
WIDE_INTERVAL_PCT = 60.0
SPEND_SHIFT_PCT = 10.0
HOLIDAY_SCORE = 0.3
TOP_CAMPAIGNS = 3
SEVERITIES = ["critical", "warning", "positive", "info"]
TYPES = ["revenue_trend", "platform_share", "forecast_confidence", "top_campaign",
         "spend_momentum", "holiday_signal"]
# ---------------------------------------------------------------------------------------

RECORD = [
    "type", "severity", "title", "explanation", "metric_name", "metric_value", "metric_unit",
    "campaign_id", "platform", "confidence",
]


def _record(df: DataFrame, kind: str, severity: Column | str, title: Column, explanation: Column,
            metric: str, value: Column | str, unit: str, confidence: float,
            campaign: str | None = None, platform: str | None = None) -> DataFrame:
    def text(c):
        return (F.col(c) if c else F.lit(None)).cast("string")

    return df.select(
        F.lit(kind).alias("type"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        title.alias("title"),
        explanation.alias("explanation"),
        F.lit(metric).alias("metric_name"),
        (F.col(value) if isinstance(value, str) else value).alias("metric_value"),
        F.lit(unit).alias("metric_unit"),
        text(campaign).alias("campaign_id"),
        text(platform).alias("platform"),
        F.lit(confidence).alias("confidence"),
    )


def revenue_trend(fc: DataFrame, days: int = 7) -> DataFrame:
    """Period-over-period P50 revenue, when it moved by at least 5 %."""
    t = period_over_period(fc, "p50", days).filter(F.abs("change_pct") >= TREND_PCT)
    up = F.col("change_pct") >= 0
    direction = F.when(up, "up").otherwise("down")
    return _record(
        t, "revenue_trend", F.when(up, "positive").otherwise("warning"),
        fill(M.REVENUE_TREND_TITLE, direction=direction, pct=fixed(F.abs("change_pct"))),
        fill(M.REVENUE_TREND_TEXT, days=str(days), recent=whole("recent"), prior=whole("prior"),
             change=fixed("change_pct", signed=True)),
        "wow_revenue_change_pct", "change_pct", "%", 0.9,
    )


def platform_share(fc: DataFrame, days: int = 7) -> DataFrame:
    """Platforms whose revenue share moved by at least three percentage points."""
    by = two_periods(fc, "p50", days, ["platform"])
    sums = two_periods(fc, "p50", days)
    recent_total, prior_total = sums.select("recent").scalar(), sums.select("prior").scalar()
    t = (
        by.filter("n_recent > 0")
        .withColumn("_rt", recent_total).withColumn("_pt", prior_total)
        .filter("_rt > 0 AND _pt > 0")
        .withColumn("share", F.col("recent") / F.col("_rt") * 100.0)
        .withColumn("prior_share", F.col("prior") / F.col("_pt") * 100.0)
        .withColumn("delta", F.col("share") - F.col("prior_share"))
        .filter(F.abs("delta") >= SHARE_SHIFT_PP)
    )
    name = titled("platform")
    return _record(
        t, "platform_share", F.when(F.abs("delta") < SHARE_WARNING_PP, "info").otherwise("warning"),
        fill(M.PLATFORM_SHARE_TITLE, platform=name,
             direction=F.when(F.col("delta") > 0, "gaining").otherwise("losing"),
             delta=fixed("delta", signed=True)),
        fill(M.PLATFORM_SHARE_TEXT, platform=name, share=fixed("share"), recent=whole("recent"),
             prior_share=fixed("prior_share"), prior=whole("prior")),
        "platform_share_delta_pp", "delta", "pp", 0.85, platform="platform",
    )


def forecast_confidence(fc: DataFrame, days: int = 7) -> DataFrame:
    """Whole-portfolio interval width above 60 % of P50."""
    t = (
        fc.filter(in_last("date", last_date(fc), days))
        .agg(F.sum("p10").alias("p10"), F.sum("p50").alias("p50"), F.sum("p90").alias("p90"))
        .filter("p50 > 0")
        .withColumn("width", (F.col("p90") - F.col("p10")) / F.col("p50") * 100.0)
        .filter(F.col("width") > WIDE_INTERVAL_PCT)
    )
    width = fixed("width", 0)
    return _record(
        t, "forecast_confidence", "warning", fill(M.CONFIDENCE_TITLE, width=width),
        fill(M.CONFIDENCE_TEXT, p10=whole("p10"), p90=whole("p90"), p50=whole("p50"), width=width),
        "forecast_width_pct", "width", "%", 0.95,
    )


def spend_momentum(facts: DataFrame, days: int = 7, roles: Roles = PANEL) -> DataFrame:
    """Platforms whose spend moved by at least 10 %."""
    t = (
        period_over_period(facts, roles.spend, days, [roles.platform], roles)
        .filter((F.col("n_recent") > 0) & (F.abs("change_pct") >= SPEND_SHIFT_PCT))
    )
    name, change = titled(roles.platform), fixed("change_pct", signed=True)
    return _record(
        t, "spend_momentum", "info",
        fill(M.SPEND_MOMENTUM_TITLE, platform=name, change=change,
             direction=F.when(F.col("change_pct") > 0, "accelerating").otherwise("decelerating")),
        fill(M.SPEND_MOMENTUM_TEXT, platform=name, days=str(days), recent=whole("recent"),
             change=change, prior=whole("prior")),
        "spend_change_pct", "change_pct", "%", 0.9, platform=roles.platform,
    )


def holiday_signal(fs: DataFrame) -> DataFrame:
    """Mean intensity over the last eight calendar dates above 0.3."""
    t = (
        fs.filter(in_last("date", last_date(fs), 8))
        .agg(F.avg("holiday_intensity_score").alias("score"))
        .filter(F.col("score") > HOLIDAY_SCORE)
    )
    score = fixed("score", 2)
    return _record(
        t, "holiday_signal", "positive", fill(M.HOLIDAY_TITLE, score=score),
        fill(M.HOLIDAY_TEXT, score=score), "holiday_intensity_score", "score", "", 0.7,
    )


def top_campaigns(fc: DataFrame, top_n: int = TOP_CAMPAIGNS, days: int = 7) -> DataFrame:
    """Largest campaigns of the window with their share of all P50 revenue."""
    recent = fc.filter(in_last("date", last_date(fc), days))
    all_revenue = recent.agg(total("p50")).scalar()
    return (
        recent.groupBy("campaign_id").agg(F.sum("p50").alias("revenue"))
        .orderBy(F.col("revenue").desc(), "campaign_id").limit(top_n)
        .withColumn("_total", all_revenue)
        .filter("_total > 0")
        .withColumn("share_pct", ratio(F.col("revenue") * 100.0, "_total"))
        .drop("_total")
    )


def top_campaign(fc: DataFrame, top_n: int = TOP_CAMPAIGNS, days: int = 7) -> DataFrame:
    t = top_campaigns(fc, top_n, days)
    share = fixed("share_pct")
    ident = F.col("campaign_id")
    return _record(
        t, "top_campaign", "info", fill(M.TOP_CAMPAIGN_TITLE, id=ident, share=share),
        fill(M.TOP_CAMPAIGN_TEXT, id=ident, revenue=whole("revenue"), days=str(days), share=share),
        "campaign_revenue_share_pct", "share_pct", "%", 0.9, campaign="campaign_id",
    )


def by_severity(records: DataFrame, severities: list[str], types: list[str]) -> DataFrame:
    """Most severe first, then by kind, then by subject."""
    def rank(column, order):
        return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column)),
                                   F.lit(0).cast("bigint")), F.lit(99).cast("bigint"))

    return records.orderBy(rank("severity", severities), rank("type", types), "platform", "campaign_id")


def all_insights(fc: DataFrame | None = None, fs: DataFrame | None = None, days: int = 7) -> DataFrame:
    parts = []
    if fc is not None:
        parts += [revenue_trend(fc, days), platform_share(fc, days), forecast_confidence(fc, days),
                  top_campaign(fc, days=days)]
    if fs is not None:
        parts.append(spend_momentum(fs, days))
        if "holiday_intensity_score" in fs.columns:
            parts.append(holiday_signal(fs))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return by_severity(out, SEVERITIES, TYPES)

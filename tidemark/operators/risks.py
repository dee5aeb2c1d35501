"""Risk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import messages as M
from tidemark.functions.exprs import in_last, last_date
from tidemark.functions.text import fill, fixed, percent, titled, whole
from tidemark.operators.insights import by_severity
from tidemark.roles import PANEL, Roles

# --- fixed values: thresholds and severity order ----------------------------------------
UTILIZATION_LOW, UTILIZATION_CRITICAL = 0.30, 0.10
SATURATION_HIGH, SATURATION_CRITICAL = 0.75, 0.90
WIDE_INTERVAL = 0.60
ZERO_REVENUE_SHARE, MIN_SPENDING_DAYS = 0.30, 5
CONCENTRATION = 0.50
SEVERITIES = ["critical", "high", "medium", "low"]
TYPES = ["budget_utilization", "zero_revenue", "saturation", "spend_concentration",
         "forecast_confidence"]
# ---------------------------------------------------------------------------------------


def _record(df: DataFrame, kind: str, severity: Column | str, title: Column, explanation: Column,
            metric: str, value: Column, threshold: float, advice: Column,
            campaign: str | None, platform: str) -> DataFrame:
    return df.select(
        F.lit(kind).alias("type"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        title.alias("title"),
        explanation.alias("explanation"),
        F.lit(metric).alias("metric_name"),
        value.alias("metric_value"),
        F.lit(float(threshold)).alias("threshold"),
        (F.col(campaign) if campaign else F.lit(None)).cast("string").alias("campaign_id"),
        F.col(platform).cast("string").alias("platform"),
        advice.alias("recommendation"),
    )


def budget_utilization_risk(fs: DataFrame, days: int = 30, roles: Roles = PANEL) -> DataFrame:
    """Campaigns that spend at most 30 % of their budget on average."""
    t = (
        fs.filter(in_last(roles.date, last_date(fs, roles.date), days))
        .groupBy(roles.entity)
        .agg(F.min_by(roles.platform, roles.date).alias("platform"),
             F.avg("budget_utilization").alias("util"))
        .filter(F.col("util") <= UTILIZATION_LOW)
    )
    ident, critical = F.col(roles.entity), F.col("util") < UTILIZATION_CRITICAL
    return _record(
        t, "budget_utilization", F.when(critical, "critical").otherwise("high"),
        fill(M.UTILIZATION_TITLE, platform=titled("platform"), id=ident, util=percent("util")),
        fill(M.UTILIZATION_TEXT, id=ident, raw_platform=F.col("platform"), util=percent("util"),
             days=str(days), threshold="30%"),
        "mean_budget_utilization", F.col("util"), UTILIZATION_LOW,
        F.when(critical, fill(M.UTILIZATION_CRITICAL_ADVICE, id=ident))
        .otherwise(fill(M.UTILIZATION_HIGH_ADVICE, id=ident)),
        roles.entity, "platform",
    )


def saturation_risk(curves: DataFrame) -> DataFrame:
    """Campaigns close to the ceiling of their curve."""
    t = curves.filter(F.col("saturation_score") >= SATURATION_HIGH)
    sat, ident = F.col("saturation_score"), F.col("campaign_id")
    critical = sat >= SATURATION_CRITICAL
    mroas, roas = fixed("current_marginal_roas", 2), fixed("current_roas", 2)
    return _record(
        t, "saturation", F.when(critical, "critical").otherwise("high"),
        fill(M.SATURATION_TITLE, platform=titled("platform"), id=ident, sat=percent(sat)),
        fill(M.SATURATION_TEXT, id=ident, raw_platform=F.col("platform"), sat=percent(sat),
             spend=whole("avg_daily_spend"), mroas=mroas, roas=roas),
        "saturation_score", sat, SATURATION_HIGH,
        F.when(critical, fill(M.SATURATION_CRITICAL_ADVICE, id=ident))
        .otherwise(fill(M.SATURATION_HIGH_ADVICE, id=ident, mroas=mroas, roas=roas)),
        "campaign_id", "platform",
    )


def confidence_risk(fc: DataFrame, days: int = 7) -> DataFrame:
    """Campaigns whose windowed interval is at least 60 % of P50."""
    t = (
        fc.filter(in_last("date", last_date(fc), days))
        .groupBy("campaign_id")
        .agg(F.min_by("platform", "date").alias("platform"), F.sum("p10").alias("p10"),
             F.sum("p50").alias("p50"), F.sum("p90").alias("p90"))
        .filter("p50 > 0")
        .withColumn("width", (F.col("p90") - F.col("p10")) / F.col("p50"))
        .filter(F.col("width") >= WIDE_INTERVAL)
    )
    ident, width = F.col("campaign_id"), percent("width")
    return _record(
        t, "forecast_confidence", "medium",
        fill(M.CI_RISK_TITLE, platform=titled("platform"), id=ident, width=width),
        fill(M.CI_RISK_TEXT, id=ident, p10=whole("p10"), p90=whole("p90"), p50=whole("p50"),
             width=width, threshold="60%"),
        "forecast_ci_width_pct", F.col("width") * 100.0, WIDE_INTERVAL * 100, F.lit(M.CI_RISK_ADVICE),
        "campaign_id", "platform",
    )


def zero_revenue_risk(fs: DataFrame, days: int = 30, roles: Roles = PANEL) -> DataFrame:
    """Campaigns with spend but no revenue on at least 30 % of their (five or more) spending days."""
    spending = F.col(roles.spend) > 0
    zero = F.when(spending, F.when(F.col(roles.revenue) == 0, 1.0).otherwise(0.0))
    t = (
        fs.filter(in_last(roles.date, last_date(fs, roles.date), days))
        .groupBy(roles.entity)
        .agg(F.min_by(roles.platform, roles.date).alias("platform"),
             F.count_if(spending).alias("n_days"), F.avg(zero).alias("share"))
        .filter((F.col("n_days") >= MIN_SPENDING_DAYS) & (F.col("share") >= ZERO_REVENUE_SHARE))
    )
    ident, share = F.col(roles.entity), percent("share")
    return _record(
        t, "zero_revenue", "high",
        fill(M.ZERO_REVENUE_TITLE, platform=titled("platform"), id=ident, share=share),
        fill(M.ZERO_REVENUE_TEXT, id=ident, raw_platform=F.col("platform"), share=share, days=str(days)),
        "zero_revenue_fraction", F.col("share") * 100.0, ZERO_REVENUE_SHARE * 100,
        F.lit(M.ZERO_REVENUE_ADVICE), roles.entity, "platform",
    )


def concentration_risk(curves: DataFrame, threshold: float = CONCENTRATION) -> DataFrame:
    """Platforms that take more than half of all spend."""
    t = (
        curves.groupBy("platform").agg(F.sum("avg_daily_spend").alias("spend"))
        .withColumn("total", curves.agg(F.sum("avg_daily_spend")).scalar())
        .filter("total > 0")
        .withColumn("share", F.col("spend") / F.col("total"))
        .filter(F.col("share") > threshold)
    )
    name, share = titled("platform"), percent("share")
    return _record(
        t, "spend_concentration", "medium",
        fill(M.CONCENTRATION_TITLE, platform=name, share=share),
        fill(M.CONCENTRATION_TEXT, platform=name, spend=whole("spend"), total=whole("total"), share=share),
        "platform_spend_share", F.col("share") * 100.0, threshold * 100,
        fill(M.CONCENTRATION_ADVICE, platform=name), None, "platform",
    )


def all_risks(fs: DataFrame | None = None, curves: DataFrame | None = None,
              fc: DataFrame | None = None) -> DataFrame:
    parts = []
    if fs is not None:
        if "budget_utilization" in fs.columns:
            parts.append(budget_utilization_risk(fs))
        parts.append(zero_revenue_risk(fs))
    if curves is not None:
        parts += [saturation_risk(curves), concentration_risk(curves)]
    if fc is not None:
        parts.append(confidence_risk(fc))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return by_severity(out, SEVERITIES, TYPES)

"""Three platform exports to one canonical fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import no_nan, value_map
from tidemark.functions.names import meta_channel
from tidemark.operators.quality import enforce, fact_violations
from tidemark.roles import CANONICAL_SCHEMA, MATURITY_DAYS, PANEL, Roles
from tidemark.session import cut_lineage
from tidemark.sources.platforms import read_all

# --- fixed values: channel mappings, unit of cost ---------------------------------------
GOOGLE_CHANNELS = {
    "SEARCH": "Search",
    "PERFORMANCE_MAX": "PMax",
    "SHOPPING": "Shopping",
    "VIDEO": "UpperFunnel",
    "DEMAND_GEN": "UpperFunnel",
    "DISPLAY": "UpperFunnel",
}
BING_CHANNELS = {
    "Search": "Search",
    "PerformanceMax": "PMax",
    "Shopping": "Shopping",
    "Audience": "UpperFunnel",
}
MICROS = 1_000_000.0
# ---------------------------------------------------------------------------------------


def google_channel(c: Column | str) -> Column:
    return value_map(GOOGLE_CHANNELS, c, "Other")


def bing_channel(c: Column | str) -> Column:
    return value_map(BING_CHANNELS, c, "Other")


def _canonical(raw: DataFrame, platform: str, columns: dict[str, Column]) -> DataFrame:
    """Project to the canonical order and types; absent measures are NULL, NaN becomes NULL."""
    out = []
    for name, kind in CANONICAL_SCHEMA.items():
        if name == "attribution_mature":
            continue
        value = F.lit(platform) if name == "platform" else columns.get(name, F.lit(None))
        value = no_nan(value) if kind == "double" else value.cast(kind)
        out.append(value.alias(name))
    return raw.select(*out)


def harmonize_google(raw: DataFrame) -> DataFrame:
    return _canonical(raw, "google", {
        "campaign_id": F.col("campaign_id"),
        "campaign_name": F.col("campaign_name"),
        "date": F.col("segments_date"),
        "spend": F.col("metrics_cost_micros") / F.lit(MICROS),
        "revenue_attributed": F.col("metrics_conversions_value"),
        "clicks": F.col("metrics_clicks"),
        "impressions": F.col("metrics_impressions"),
        "conversions": F.col("metrics_conversions"),
        "daily_budget": F.col("campaign_budget_amount"),
        "channel_format": google_channel("campaign_advertising_channel_type"),
        "video_views": F.col("metrics_video_views"),
    })


def harmonize_meta(raw: DataFrame) -> DataFrame:
    """``conversion`` is a revenue value on this platform, not a count."""
    return _canonical(raw, "meta", {
        "campaign_id": F.col("campaign_id"),
        "campaign_name": F.col("campaign_name"),
        "date": F.col("date_start"),
        "spend": F.col("spend"),
        "revenue_attributed": F.col("conversion"),
        "clicks": F.col("clicks"),
        "impressions": F.col("impressions"),
        "daily_budget": F.col("daily_budget"),
        "channel_format": meta_channel("campaign_name"),
        "reach": F.col("reach"),
    })


def harmonize_bing(raw: DataFrame) -> DataFrame:
    return _canonical(raw, "bing", {
        "campaign_id": F.col("CampaignId"),
        "campaign_name": F.col("CampaignName"),
        "date": F.col("TimePeriod"),
        "spend": F.col("Spend"),
        "revenue_attributed": F.col("Revenue"),
        "clicks": F.col("Clicks"),
        "impressions": F.col("Impressions"),
        "conversions": F.col("Conversions"),
        "daily_budget": F.col("DailyBudget"),
        "channel_format": bing_channel("CampaignType"),
    })


def flag_maturity(df: DataFrame, days: int = MATURITY_DAYS, roles: Roles = PANEL, of: DataFrame | None = None) -> DataFrame:
    """Mature = at least ``days`` before the platform's own last day, whatever the platform's name.

    The last days come back as one scalar map with an entry per platform.  No shuffle is keyed by
    platform alone, which would send a whole platform to one task.  ``of`` may name a
    cheaper frame with the same last days.  A null platform gives a null flag.
    """
    platform, date = F.col(roles.platform), F.col(roles.date)
    pairs = (df if of is None else of).filter(platform.isNotNull()).select(platform.alias("p"), date.alias("d")).distinct()
    # At most one pair for each platform and calendar day.
    seen = pairs.agg(F.collect_list(F.struct("p", "d")).alias("seen"))
    days_of = lambda p: F.transform(F.filter("seen", lambda x: x["p"] == p), lambda x: x["d"])
    names = F.array_distinct(F.transform("seen", lambda x: x["p"]))
    last_days = seen.select(F.map_from_entries(F.transform(names, lambda p: F.struct(p, F.array_max(days_of(p)))))).scalar()
    return df.withColumn(roles.mature, date <= F.date_sub(F.try_element_at(last_days, platform), days))


def canonical_projection(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in CANONICAL_SCHEMA.items()])


def union_platforms(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def harmonize(google: DataFrame, meta: DataFrame, bing: DataFrame, check: bool = True) -> DataFrame:
    """Canonical facts of the three exports; with ``check`` the integrity rules run as one job."""
    facts = union_platforms(harmonize_google(google), harmonize_meta(meta), harmonize_bing(bing))
    # With the checks four passes read the rows: the exports are parsed once for all of them.
    facts = canonical_projection(flag_maturity(cut_lineage(facts) if check else facts))
    if check:
        enforce(fact_violations(facts), facts)
    return facts


def harmonize_from_dir(spark, folder: str, check: bool = True) -> DataFrame:
    raw = read_all(spark, folder)
    return harmonize(raw["google"], raw["meta"], raw["bing"], check=check)

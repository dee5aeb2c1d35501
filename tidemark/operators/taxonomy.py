"""Campaign dimension from campaign names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.functions.exprs import require_columns
from tidemark.operators.quality import dimension_violations, enforce

SEARCH_PLATFORMS = ["google", "bing"]
SOCIAL_PLATFORM = "meta"

DIMENSION_COLUMNS = [
    "platform", "campaign_id", "campaign_name", "channel_format", "format", "audience_strategy",
    "funnel_stage", "ad_product_type", "campaign_number", "strategy_key",
    "cross_engine_pair_flag", "is_brand", "is_non_brand", "is_upper_funnel",
]


def unique_campaigns(facts: DataFrame) -> DataFrame:
    """One row per (platform, campaign): the name and channel of its first day.

    First the distinct spellings, a hash aggregate that combines on the map side and leaves about
    one row per campaign; only those are compared by date, with the name as tie-breaker.
    """
    spelling = ["platform", "campaign_id", "campaign_name", "channel_format"]
    since = F.min("date") if "date" in facts.columns else F.lit(None).cast("date")
    spellings = facts.groupBy(*spelling).agg(F.coalesce(since, F.lit("1970-01-01").cast("date")).alias("_since"))
    first = F.min_by(F.struct("campaign_name", "channel_format"),
                     F.struct("_since", "campaign_name", "channel_format"))
    return (
        spellings.groupBy("platform", "campaign_id").agg(first.alias("_first"))
        .select("platform", "campaign_id", "_first.campaign_name", "_first.channel_format")
    )


def parse_names(campaigns: DataFrame) -> DataFrame:
    """All name-derived columns; search and social conventions are branches of one projection."""
    search = F.col("platform").isin(SEARCH_PLATFORMS)
    social = F.col("platform") == SOCIAL_PLATFORM
    name = F.col("campaign_name")
    out = campaigns.withColumns({
        "format": F.when(search, names.search_format(name)),
        "audience_strategy": F.when(search, names.audience_strategy(name)),
        "funnel_stage": F.when(social, names.funnel_stage(name)),
        "ad_product_type": F.when(social, names.ad_product_type(name)),
        "campaign_number": names.campaign_number(name),
    })
    brand = (F.col("audience_strategy") == "TM") | (F.col("ad_product_type") == "Brand")
    non_brand = (F.col("audience_strategy") == "NTM") | F.col("ad_product_type").isin("DPA", "Adv_Plus")
    return out.withColumns({
        "strategy_key": names.strategy_key(
            "platform",
            F.coalesce("format", "funnel_stage"),
            F.coalesce("audience_strategy", "ad_product_type"),
        ),
        "is_brand": F.coalesce(brand, F.lit(False)),
        "is_non_brand": F.coalesce(non_brand, F.lit(False)),
        "is_upper_funnel": F.coalesce(F.col("channel_format") == "UpperFunnel", F.lit(False)),
    })


def flag_cross_engine(campaigns: DataFrame) -> DataFrame:
    """Flag every row whose name runs on both search engines."""
    shared = (
        campaigns.groupBy("campaign_name")
        .agg(
            F.bool_or(F.col("platform") == "google").alias("_g"),
            F.bool_or(F.col("platform") == "bing").alias("_b"),
        )
        .filter("_g AND _b")
        .select("campaign_name", F.lit(True).alias("_shared"))
    )
    return (
        campaigns.join(shared, "campaign_name", "left")
        .withColumn("cross_engine_pair_flag", F.coalesce("_shared", F.lit(False)))
        .drop("_shared")
    )


def parse_taxonomy(facts: DataFrame, check: bool = False) -> DataFrame:
    """Campaign dimension of a fact table; rows of other platforms have no convention and drop out."""
    require_columns(facts, ["platform", "campaign_id", "campaign_name", "channel_format"])
    known = F.col("platform").isin(*SEARCH_PLATFORMS, SOCIAL_PLATFORM)
    dim = flag_cross_engine(parse_names(unique_campaigns(facts.filter(known)))).select(*DIMENSION_COLUMNS)
    if check:
        enforce(dimension_violations(dim))
    return dim

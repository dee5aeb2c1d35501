"""Column roles and default feature specifications of an entity-by-day panel."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Roles:
    """Which columns of a panel play which part; every operator takes one of these."""

    platform: str = "platform"
    entity: str = "campaign_id"
    name: str = "campaign_name"
    date: str = "date"
    spend: str = "spend"
    revenue: str = "revenue_attributed"
    budget: str = "daily_budget"
    mature: str = "attribution_mature"

    @property
    def grain(self) -> list[str]:
        return [self.entity, self.date]

    @property
    def key(self) -> list[str]:
        return [self.platform, self.entity, self.date]


PANEL = Roles()

# --- fixed values: canonical schema, feature specifications, manifests -----------------
MATURITY_DAYS = 14

CANONICAL_SCHEMA = {
    "platform": "string",
    "campaign_id": "bigint",
    "campaign_name": "string",
    "date": "date",
    "spend": "double",
    "revenue_attributed": "double",
    "clicks": "double",
    "impressions": "double",
    "conversions": "double",
    "daily_budget": "double",
    "channel_format": "string",
    "reach": "double",
    "video_views": "double",
    "attribution_mature": "boolean",
}

LAG_SPEC = {
    "revenue_attributed": (1, 3, 7, 14, 28),
    "spend": (1, 3, 7, 14, 28),
    "clicks": (1, 7, 14, 28),
    "impressions": (1, 7, 14, 28),
    "conversions": (1, 7, 14, 28),
}

ROLLING_SPEC = {
    "revenue_attributed": {"mean": (7, 14, 28), "std": (7, 14, 28), "min": (7,), "max": (7,)},
    "spend": {"mean": (7, 14, 28), "std": (7, 14, 28)},
    "clicks": {"mean": (7, 14, 28)},
    "impressions": {"mean": (7, 14, 28)},
}

MOMENTUM_SPEC = {"revenue": (7, 14, 28), "spend": (7, 14, 28)}
ROAS_LAGS = (7, 14, 28)

# Output columns of the target start with this shorter stem.
PREFIX = {"revenue_attributed": "revenue"}

CALENDAR_PART_COLUMNS = [
    "day_of_week", "day_of_month", "week_of_year", "month", "quarter", "year", "is_weekend",
]
BUDGET_COLUMNS = ["budget_utilization", "budget_headroom"]
TAXONOMY_COLUMNS = [
    "format", "audience_strategy", "funnel_stage", "ad_product_type", "strategy_key",
    "is_brand", "is_non_brand", "is_upper_funnel", "cross_engine_pair_flag",
]
HOLIDAY_COLUMNS = [
    "is_holiday", "is_bfcm", "is_cyber_week", "is_holiday_season",
    "days_to_black_friday", "days_since_black_friday",
    "days_to_thanksgiving", "days_since_thanksgiving", "holiday_intensity_score",
]
NON_FEATURES = {
    "revenue_attributed", "date", "campaign_id", "campaign_name", "platform",
    "attribution_mature", "holiday_name",
}
CATEGORICAL_FEATURES = [
    "format", "audience_strategy", "funnel_stage", "ad_product_type", "strategy_key",
    "channel_format",
]
# ---------------------------------------------------------------------------------------


def stem(column: str) -> str:
    return PREFIX.get(column, column)


def lag_columns(spec=None) -> list[str]:
    return [f"{stem(c)}_lag_{n}" for c, lags in (spec or LAG_SPEC).items() for n in lags]


def rolling_columns(spec=None) -> list[str]:
    return [
        f"{stem(c)}_roll_{agg}_{w}"
        for c, aggs in (spec or ROLLING_SPEC).items()
        for agg, windows in aggs.items()
        for w in windows
    ]


def momentum_columns(spec=None) -> list[str]:
    return [f"{p}_momentum_{w}" for p, windows in (spec or MOMENTUM_SPEC).items() for w in windows]


def roas_columns() -> list[str]:
    return [f"roas_lag_{w}" for w in ROAS_LAGS]

"""Data-quality checks as frames of (check_name, n_rows); ``enforce`` turns findings into errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import QualityError
from tidemark.functions.exprs import require_columns
from tidemark.roles import (
    BUDGET_COLUMNS, CALENDAR_PART_COLUMNS, PANEL, Roles, roas_columns,
)

SAMPLE_ROWS = 5


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; counts combine before the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def _named(check: str, df: DataFrame, value) -> DataFrame:
    return df.agg(F.coalesce(value, F.lit(0)).cast("bigint").alias("n_rows")).select(
        F.lit(check).alias("check_name"), "n_rows"
    )


def fact_violations(df: DataFrame, roles: Roles = PANEL) -> DataFrame:
    """Negative spend, negative revenue, rows in duplicated keys; one row per check, 0 when clean.

    The row-level checks share one pass; duplicates count every row of a repeated key.
    """
    require_columns(df, [*roles.key, roles.spend, roles.revenue])
    row_checks = df.agg(
        F.count_if(F.col(roles.spend) < 0).alias("negative_spend"),
        F.count_if(F.col(roles.revenue) < 0).alias("negative_revenue"),
    ).unpivot([], ["negative_spend", "negative_revenue"], "check_name", "n_rows")
    return row_checks.unionByName(_named("duplicate_key", duplicate_keys(df, roles.key), F.sum("n_rows")))


def dimension_violations(dim: DataFrame, roles: Roles = PANEL) -> DataFrame:
    """Surplus rows per platform whose campaign id or name already occurred in it."""
    parts = []
    for label, column in (("duplicate_id", roles.entity), ("duplicate_name", roles.name)):
        per_value = dim.groupBy(roles.platform, column).agg((F.count(F.lit(1)) - 1).alias("surplus"))
        parts.append(
            per_value.groupBy(roles.platform).agg(F.sum("surplus").cast("bigint").alias("n_rows"))
            .select(F.lit(label).alias("check_name"), roles.platform, "n_rows")
        )
    return parts[0].unionByName(parts[1])


def input_violations(df: DataFrame, required: list[str], roles: Roles = PANEL) -> DataFrame:
    """Empty input and NULL keys; missing columns already raise while planning."""
    require_columns(df, {*roles.grain, *required})
    return df.agg(
        F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("bigint").alias("empty_input"),
        F.count_if(F.col(roles.date).isNull()).alias("null_date"),
        F.count_if(F.col(roles.entity).isNull()).alias("null_entity"),
    ).unpivot([], ["empty_input", "null_date", "null_entity"], "check_name", "n_rows")


def feature_store_violations(df: DataFrame, roles: Roles = PANEL) -> DataFrame:
    """Rows beyond the first per (campaign, day), plus the manifest check."""
    require_columns(
        df, [roles.revenue, *CALENDAR_PART_COLUMNS, *BUDGET_COLUMNS, *roas_columns()], "feature store"
    )
    return _named("duplicate_grain", duplicate_keys(df, roles.grain), F.sum(F.col("n_rows") - 1))


def unmatched(facts: DataFrame, dim: DataFrame, keys: list[str], check: str) -> DataFrame:
    """How many fact rows have no partner in a dimension."""
    return _named(check, facts.join(dim.select(*keys), keys, "left_anti"), F.count(F.lit(1)))


def forecast_violations(fc: DataFrame) -> DataFrame:
    """Summary and defects of a forecast table in one aggregation."""
    require_columns(fc, ["date", "campaign_id", "platform", "p10", "p50", "p90", "is_future"], "forecast")
    return fc.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(F.col("campaign_id")).alias("n_campaigns"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
        F.count_if(F.col("is_future")).alias("n_future"),
        F.count_if(~F.col("is_future")).alias("n_history"),
        F.count_if((F.col("p10") > F.col("p50")) | (F.col("p50") > F.col("p90"))).alias("n_crossings"),
        F.count_if(F.col("p50") < 0).alias("n_negative_p50"),
    )


def enforce(violations: DataFrame, df: DataFrame | None = None, roles: Roles = PANEL) -> None:
    """Raise on any finding, with a few offending rows.  Only the handful of checks is collected."""
    found = [r for r in violations.collect() if r["n_rows"] > 0]
    if not found:
        return
    text = "; ".join(f"{r['check_name']}: {r['n_rows']} rows" for r in found)
    raise QualityError(text + _sample(found[0]["check_name"], df, roles))


def _sample(check: str, df: DataFrame | None, roles: Roles) -> str:
    if df is None:
        return ""
    bad = {
        "negative_spend": lambda: df.filter(F.col(roles.spend) < 0).select(*roles.key, roles.spend),
        "negative_revenue": lambda: df.filter(F.col(roles.revenue) < 0).select(*roles.key, roles.revenue),
        "duplicate_key": lambda: duplicate_keys(df, roles.key),
        "duplicate_grain": lambda: duplicate_keys(df, roles.grain),
    }.get(check)
    if bad is None:
        return ""
    return "\n" + "\n".join(str(r.asDict()) for r in bad().limit(SAMPLE_ROWS).collect())

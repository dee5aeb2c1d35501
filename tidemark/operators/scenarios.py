"""What-if projections of many spend scenarios over response curves.

A scenario set is a small literal table (scenario, platform, multiplier).  Each curve row expands
into one row per scenario through an array, so nothing is joined pairwise and the totals combine
on the map side.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import curves as C
from tidemark.functions.exprs import ratio0

UNCHANGED = 1e-9           # fixed value: below this a spend counts as unchanged
CI_SCALE, CI_Z = 0.35, 1.28
RISK_WEIGHTS = (0.5, 0.35, 0.15)  # saturation, unreliable curves, concentration


@dataclass(frozen=True)
class Scenario:
    """Spend multipliers by platform, then absolute overrides by campaign."""

    name: str
    description: str = ""
    multipliers: dict[str, float] = field(default_factory=dict)
    overrides: dict[int, float] = field(default_factory=dict)


# --- fixed values: the standard scenario set --------------------------------------------
STANDARD_SCENARIOS = [
    Scenario("Baseline", "No budget change."),
    Scenario("Google Boost", "Increase Google spend by 20%, reduce Meta by 10%.",
             {"google": 1.20, "meta": 0.90}),
    Scenario("Meta Boost", "Reduce Google by 20%, increase Meta by 20%.",
             {"google": 0.80, "meta": 1.20}),
    Scenario("Scale Up", "Increase all platforms by 10%.",
             {"google": 1.10, "meta": 1.10, "bing": 1.10}),
    Scenario("Scale Down", "Reduce all platforms by 10%.",
             {"google": 0.90, "meta": 0.90, "bing": 0.90}),
]
# ---------------------------------------------------------------------------------------


def _multiplier(s: Scenario) -> Column:
    out = F.lit(1.0)
    for platform, m in s.multipliers.items():
        out = F.when(F.col("platform") == platform, float(m)).otherwise(out)
    return out


def override_table(spark, scenarios: list[Scenario]) -> DataFrame | None:
    """Campaign overrides as a table, so that long lists never become one giant expression."""
    rows = [(s.name, int(c), float(x)) for s in scenarios for c, x in s.overrides.items()]
    if not rows:
        return None
    return spark.createDataFrame(rows, "scenario string, campaign_id bigint, override_spend double")


def project_spend(curves: DataFrame, scenarios: list[Scenario], overrides: DataFrame | None = None) -> DataFrame:
    """scenario x campaign projections.  ``overrides``: (scenario, campaign_id, override_spend)."""
    if overrides is None:
        overrides = override_table(curves.sparkSession, scenarios)
    options = F.array(*[
        F.struct(F.lit(s.name).alias("scenario"), F.lit(s.description).alias("description"),
                 _multiplier(s).alias("multiplier"))
        for s in scenarios
    ])
    rows = curves.withColumn("_s", F.explode(options)).select("*", "_s.*").drop("_s")
    wanted = F.col("avg_daily_spend") * F.col("multiplier")
    if overrides is not None:
        rows = rows.join(overrides, ["scenario", "campaign_id"], "left")
        wanted = F.coalesce("override_spend", wanted)
    rows = rows.withColumn("new_daily_spend", F.greatest(wanted, F.lit(0.0)))
    base, new = F.col("avg_daily_spend"), F.col("new_daily_spend")
    base_rev = F.col("avg_daily_revenue")
    unchanged = F.abs(new - base) < UNCHANGED
    rows = rows.withColumn("projected_daily_revenue", F.when(unchanged, base_rev).otherwise(C.hill(new)))
    gain = F.col("projected_daily_revenue") - base_rev
    return rows.select(
        "scenario", "description", "campaign_id", "campaign_name", "platform",
        base.alias("baseline_daily_spend"),
        "new_daily_spend",
        (new - base).alias("spend_delta"),
        base_rev.alias("baseline_daily_revenue"),
        "projected_daily_revenue",
        gain.alias("revenue_delta"),
        F.when(base_rev > 0, gain * 100.0 / base_rev).otherwise(F.lit(0.0)).alias("revenue_delta_pct"),
        C.marginal_roas(base).alias("baseline_marginal_roas"),
        C.marginal_roas(new).alias("new_marginal_roas"),
        C.saturation(new).alias("new_saturation"),
        "r_squared",
        "is_reliable",
    ).withColumn(
        "spend_delta_pct",
        F.when(F.col("baseline_daily_spend") > 0,
               F.col("spend_delta") * 100.0 / F.col("baseline_daily_spend")).otherwise(F.lit(0.0)),
    )


PROJECTION_COLUMNS = [
    "scenario", "campaign_id", "campaign_name", "platform", "baseline_daily_spend",
    "new_daily_spend", "spend_delta", "spend_delta_pct", "baseline_daily_revenue",
    "projected_daily_revenue", "revenue_delta", "revenue_delta_pct",
    "baseline_marginal_roas", "new_marginal_roas",
]


def _clip01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def weighted_risk(total: str, sat: str, unreliable: str, squares: str) -> Column:
    """Risk in [0, 1] from spend-weighted sums that one aggregation delivers.

    sum(s/T * sat) = sum(s * sat) / T, and sum((s/T)^2) = sum(s^2) / T^2.
    """
    a, b, c = RISK_WEIGHTS
    t = F.col(total)
    risk = a * F.col(sat) / t + b * F.col(unreliable) / t + c * F.col(squares) / (t * t)
    return F.when(t > 0, _clip01(risk)).otherwise(F.lit(0.0))


def scenario_summary(projections: DataFrame) -> DataFrame:
    """Totals, lift, ROAS, confidence interval and risk of each scenario, in one aggregation."""
    new = F.col("new_daily_spend")
    used = F.when(new > 0, new).otherwise(0.0)
    loose = used * (1.0 - F.when(F.col("is_reliable"), F.col("r_squared")).otherwise(0.0)) * CI_SCALE
    sums = projections.groupBy("scenario").agg(
        F.sum("baseline_daily_revenue").alias("baseline_revenue"),
        F.sum("projected_daily_revenue").alias("projected_revenue"),
        F.sum("baseline_daily_spend").alias("baseline_spend"),
        F.sum(new).alias("new_spend"),
        F.sum(loose).alias("_loose"),
        F.sum(used * F.col("new_saturation")).alias("_sat"),
        F.sum(F.when(F.col("is_reliable"), 0.0).otherwise(used)).alias("_unreliable"),
        F.sum(used * used).alias("_squares"),
    )
    t = F.col("new_spend")
    half = F.when(t > 0, F.col("projected_revenue") * F.col("_loose") / t * CI_Z).otherwise(F.lit(0.0))
    lift = F.col("projected_revenue") - F.col("baseline_revenue")
    return sums.select(
        "scenario",
        "baseline_revenue",
        "projected_revenue",
        lift.alias("revenue_lift"),
        F.when(F.col("baseline_revenue") > 0, lift / F.col("baseline_revenue") * 100.0)
        .otherwise(F.lit(0.0)).alias("revenue_lift_pct"),
        "baseline_spend",
        "new_spend",
        ratio0("baseline_revenue", "baseline_spend").alias("baseline_roas"),
        ratio0("projected_revenue", "new_spend").alias("projected_roas"),
        F.when(t > 0, F.greatest(F.lit(0.0), F.col("projected_revenue") - half))
        .otherwise(F.col("projected_revenue")).alias("ci_low"),
        (F.col("projected_revenue") + half).alias("ci_high"),
        weighted_risk("new_spend", "_sat", "_unreliable", "_squares").alias("risk_score"),
    )


def apply_scenario(curves: DataFrame, scenario: Scenario, overrides: DataFrame | None = None) -> DataFrame:
    return project_spend(curves, [scenario], overrides)


def standard_scenarios(curves: DataFrame) -> DataFrame:
    """Comparison table of the standard scenario set."""
    return scenario_summary(project_spend(curves, STANDARD_SCENARIOS))

"""Budget allocation: maximise total curve revenue under a total-spend constraint and bounds.

The constraint is priced by a multiplier: for a price p every campaign independently picks the
spend in its bounds that maximises revenue(x) - p * x, and the total falls as p rises.  A round
evaluates a few dozen prices for all campaigns in one distributed aggregation and returns one sum
per price to the driver, which narrows the bracket.  Each campaign's choice is global (S-shaped
curves compare their lower bound with their concave branch), so there are no local optima; the
jump an S-shaped campaign can make at the final price is closed explicitly.  The price also gives an
upper bound on revenue, and the summary says how near the allocation comes to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.errors import CurveError
from tidemark.functions import curves as C
from tidemark.functions.exprs import ratio0
from tidemark.operators.scenarios import weighted_risk
from tidemark.session import cut_lineage

MAX_SHIFT = 0.40           # fixed value: default bound, +-40 % of current spend
PRICES_PER_ROUND = 33
MAX_ROUNDS = 12
BISECTIONS = 60
PRICED_ROWS = 256          # campaigns that meet all prices of a round at once: their spends stay in the cache
SUM_BUCKETS = 4096
TOLERANCE = 1e-9           # of the budget
OPTIMAL_GAP = 1e-6         # of the revenue: what still counts as optimal


@dataclass(frozen=True)
class Allocation:
    """Result of one optimisation: the allocation table and its one-row summary."""

    table: DataFrame
    summary: DataFrame
    converged: bool
    rounds: int
    gap: float  # of revenue to its upper bound, as a share


def spend_bounds(curves: DataFrame, constraints: DataFrame | None = None,
                 max_shift: float = MAX_SHIFT) -> DataFrame:
    """Curves with [low, high]: a band around current spend, replaced by explicit constraints.

    ``constraints``: (campaign_id, min_daily_spend, max_daily_spend); NULL means 0 and unlimited.
    """
    base = F.col("avg_daily_spend")
    low, high = base * (1.0 - max_shift), base * (1.0 + max_shift)
    if constraints is not None:
        wanted = constraints.select(
            "campaign_id",
            F.coalesce("min_daily_spend", F.lit(0.0)).alias("_min"),
            F.coalesce("max_daily_spend", F.lit(float("inf"))).alias("_max"),
        )
        curves = curves.join(wanted, "campaign_id", "left")
        low, high = F.coalesce("_min", low), F.coalesce("_max", high)
    out = curves.withColumn("low", F.greatest(low, F.lit(0.0))).withColumn("high", F.greatest(high, F.col("low")))
    return out.drop("_min", "_max")


def _chooser():
    """The best spend of campaigns at prices, over numpy arrays that broadcast against each other.

    Helpers are nested so that the function travels to the executors by value.
    """
    bisections = BISECTIONS

    def choose(v, k, n, low, high, price):
        with np.errstate(all="ignore"):
            def share(x):
                return 1.0 / (1.0 + (x / k) ** -n)

            def revenue(x):
                return np.where(x > 0, v * share(x), 0.0)

            at_zero, steep = np.where(n < 1, np.inf, np.where(n > 1, 0.0, v / k)), v * n

            def slope(x):
                s = share(x)
                return np.where(x > 0, steep * s * (1.0 - s) / x, at_zero)

            # Right of the inflection the slope falls, so the price is met at most once there.
            knee = np.where(n > 1, k * np.maximum((n - 1.0) / (n + 1.0), 0.0) ** (1.0 / n), 0.0)
            start = np.clip(knee, low, high)
            left, right = start + 0.0 * price, high + 0.0 * price
            for _ in range(bisections):
                mid = 0.5 * (left + right)
                rising = slope(mid) > price
                left, right = np.where(rising, mid, left), np.where(rising, right, mid)
            top = np.where(slope(high) >= price, high, np.where(slope(start) <= price, start, 0.5 * (left + right)))
            gain = revenue(top) - revenue(low) - price * (top - low)
            return np.where(gain > 0, top, low)

    return choose


def _priced(price: Column) -> Column:
    choose = _chooser()

    def best_spend(v: pd.Series, k: pd.Series, n: pd.Series, low: pd.Series, high: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series(choose(*(c.to_numpy(float) for c in (v, k, n, low, high, p))))

    return F.pandas_udf(best_spend, DoubleType())("v_max", "k", "n", "low", "high", price)


def _knee(k: float, n: float) -> float:
    """Inflection point of an S-shaped curve, 0 for a concave one."""
    return k * ((n - 1.0) / (n + 1.0)) ** (1.0 / n) if n > 1 else 0.0


def _totals(rows: DataFrame, prices: list[float]) -> dict[float, float]:
    """Total chosen spend per price.  A batch of campaigns meets all prices at once and leaves one sum each."""
    choose, grid, block = _chooser(), np.array(prices, float), PRICED_ROWS

    def sums(batches):
        for b in batches:
            columns = [b[c].to_numpy(float)[:, None] for c in ("v_max", "k", "n", "low", "high")]
            spend = [choose(*[c[lo:lo + block] for c in columns], grid[None, :]) for lo in range(0, len(b), block)]
            yield pd.DataFrame({"price": grid, "x": np.concatenate(spend).sum(axis=0) if spend else 0.0})

    out = rows.select("v_max", "k", "n", "low", "high").mapInPandas(sums, "price double, x double")
    return {r["price"]: r["x"] for r in out.groupBy("price").agg(F.sum("x").alias("x")).collect()}


def _bracket(rows: DataFrame, budget: float) -> tuple[float, float, int]:
    """Prices (cheap, dear) with total(cheap) >= budget >= total(dear), as tight as rounds allow."""
    # Any price above the steepest chord-or-tangent anywhere in bounds makes everyone choose `low`.
    dear = (rows.agg(F.max(F.greatest(
        C.marginal_roas(F.greatest("low", F.col("k") * 1e-9)), C.marginal_roas("high"),
        F.col("v_max") * F.col("n") / F.col("k"),
    ))).first()[0] or 1.0) * 2.0
    cheap, rounds = 0.0, 0
    prices = list(np.geomspace(dear * 1e-9, dear, PRICES_PER_ROUND))
    while rounds < MAX_ROUNDS:
        rounds += 1
        sums = _totals(rows, prices)
        above = [p for p, x in sums.items() if x >= budget]
        below = [p for p, x in sums.items() if x <= budget]
        if not below:  # even the dearest price overspends
            cheap, dear = max(above), dear * 1e3
            prices = list(np.geomspace(cheap, dear, PRICES_PER_ROUND))
            continue
        cheap = max(above, default=cheap)
        dear = min(p for p in below if p >= cheap) if any(p >= cheap for p in below) else cheap
        if cheap in sums and sums[cheap] - sums[dear] <= TOLERANCE * budget or dear - cheap <= 1e-15 * dear:
            break
        prices = list(np.linspace(cheap, dear, PRICES_PER_ROUND))
    return cheap, dear, rounds


def _fill(rows: DataFrame, cheap: float, dear: float, budget: float) -> DataFrame:
    """Start from the dear choice and hand the remaining budget out, campaign by campaign.

    The running total is two-level (hash buckets, then rows of a bucket), so that millions of
    identical campaigns are filled exactly without a single-task window over all of them.
    """
    moved = rows.withColumn("_dn", _priced(F.lit(dear))).withColumn("_up", _priced(F.lit(cheap)))
    moved = moved.withColumn("_step", F.greatest(F.col("_up") - F.col("_dn"), F.lit(0.0))).withColumn(
        "_bucket", F.pmod(F.xxhash64("campaign_id"), F.lit(SUM_BUCKETS))
    )
    before = F.coalesce(F.sum("_b").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)),
                        F.lit(0.0))
    buckets = moved.groupBy("_bucket").agg(F.sum("_step").alias("_b")).select("_bucket", before.alias("_before"))
    rest = F.lit(budget) - moved.agg(F.sum("_dn")).scalar()
    inside = Window.partitionBy("_bucket").orderBy("campaign_id").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("_before") + F.sum("_step").over(inside) - F.col("_step")
    return (
        moved.join(buckets, "_bucket")
        .withColumn("_given", F.least(F.col("_step"), F.greatest(rest - start, F.lit(0.0))))
        .withColumn("optimal_spend", F.col("_dn") + F.col("_given"))
        .drop("_bucket", "_before")
    )


def _split_campaign(filled: DataFrame, budget: float):
    """The campaign left inside a jump: neither at its dear nor at its cheap choice."""
    partial = (F.col("_given") > TOLERANCE * budget) & (F.col("_step") - F.col("_given") > TOLERANCE * budget)
    return filled.filter(partial & (F.col("n") > 1)).orderBy(F.col("_step").desc(), "campaign_id").select(
        "campaign_id", "low", "high", "k", "n", "_dn"
    ).first()


def _search(rows: DataFrame, budget: float) -> tuple[DataFrame, int, float]:
    """Allocation, rounds, and the revenue that no allocation can pass: what all campaigns earn above the
    price at their best, and the price of the budget."""
    cheap, dear, rounds = _bracket(rows, budget)
    # The bound, the split campaign, the worth and the table all read it.
    filled = cut_lineage(_fill(rows, cheap, dear, budget))
    bound = filled.agg(F.sum(C.hill("_dn") - F.lit(dear) * F.col("_dn"))).first()[0] + dear * budget
    return filled, rounds, bound


def _with_bounds(rows: DataFrame, ident, low: float, high: float) -> DataFrame:
    mine = F.col("campaign_id") == F.lit(ident)
    return rows.withColumn("low", F.when(mine, F.lit(low)).otherwise(F.col("low"))).withColumn(
        "high", F.when(mine, F.lit(high)).otherwise(F.col("high"))
    )


def optimise(rows: DataFrame, budget: float) -> tuple[DataFrame, int, float]:
    """Rows with ``optimal_spend``, rounds, and how far their revenue may be from the best, as a share of it.

    A split S-shaped campaign is also tried on either branch.
    """
    best, rounds, bound = _search(rows, budget)
    options = [best]
    split = _split_campaign(best, budget)
    if split is not None:
        knee = min(max(_knee(split["k"], split["n"]), split["low"]), split["high"])
        for low, high in ((knee, split["high"]), (split["low"], split["_dn"])):
            bounded = _with_bounds(rows, split["campaign_id"], low, high)
            reach = bounded.agg(F.sum("low"), F.sum("high")).first()
            if reach[0] <= budget <= reach[1]:
                option, more, _ = _search(bounded, budget)
                options.append(option)
                rounds += more
    worth = [o.agg(F.sum(C.hill("optimal_spend"))).first()[0] for o in options]
    return options[int(np.argmax(worth))], rounds, max(0.0, bound - max(worth)) / max(abs(bound), 1e-300)


def allocate_budget(
    curves: DataFrame,
    budget: float | None = None,
    constraints: DataFrame | None = None,
    max_shift: float = MAX_SHIFT,
) -> Allocation:
    """Best allocation of ``budget`` (default: current total spend)."""
    bounded = cut_lineage(spend_bounds(curves, constraints, max_shift))
    totals = bounded.agg(
        F.count(F.lit(1)).alias("n"), F.sum("low").alias("low"), F.sum("high").alias("high"),
        F.sum("avg_daily_spend").alias("spend"),
    ).first()
    if totals["n"] == 0:
        raise CurveError("no response curves")
    budget = totals["spend"] if budget is None else float(budget)
    if budget <= 0:
        raise CurveError(f"budget must be positive, got {budget}")
    # An unlimited bound never needs more than the whole budget.
    rows = bounded.withColumn("high", F.greatest(F.least("high", F.lit(budget)), F.col("low")))
    feasible = totals["low"] <= budget <= totals["high"]
    if feasible:
        filled, rounds, gap = optimise(rows, budget)
    else:
        edge = "low" if budget < totals["low"] else "high"
        filled, rounds, gap = rows.withColumn("optimal_spend", F.col(edge)), 0, 0.0
    table = allocation_table(filled)
    return Allocation(table, allocation_summary(table, budget, feasible, rounds, gap), feasible, rounds, gap)


def allocation_table(filled: DataFrame) -> DataFrame:
    base, best = F.col("avg_daily_spend"), F.col("optimal_spend")
    base_rev, best_rev = F.col("avg_daily_revenue"), C.hill("optimal_spend")
    return filled.select(
        "campaign_id", "campaign_name", "platform",
        base.alias("baseline_spend"),
        "optimal_spend",
        (best - base).alias("spend_delta"),
        F.when(base > 0, (best - base) / base * 100.0).otherwise(F.lit(0.0)).alias("spend_delta_pct"),
        base_rev.alias("baseline_revenue"),
        best_rev.alias("optimal_revenue"),
        (best_rev - base_rev).alias("revenue_delta"),
        F.when(base_rev > 0, (best_rev - base_rev) / base_rev * 100.0).otherwise(F.lit(0.0))
        .alias("revenue_delta_pct"),
        C.marginal_roas(base).alias("baseline_marginal_roas"),
        C.marginal_roas(best).alias("optimal_marginal_roas"),
        C.saturation(best).alias("saturation_at_optimal"),
        "is_reliable",
    )


def allocation_summary(table: DataFrame, budget: float, feasible: bool = True, rounds: int = 0, gap: float = 0.0) -> DataFrame:
    x = F.col("optimal_spend")
    sums = table.agg(
        F.sum("baseline_revenue").alias("baseline_total_revenue"),
        F.sum("optimal_revenue").alias("optimal_total_revenue"),
        F.sum("baseline_spend").alias("_base"),
        F.sum(x).alias("budget_allocated"),
        F.sum(x * F.col("saturation_at_optimal")).alias("_sat"),
        F.sum(F.when(F.col("is_reliable"), 0.0).otherwise(x)).alias("_unreliable"),
        F.sum(x * x).alias("_squares"),
    ).withColumn("total_budget", F.lit(float(budget)))
    lift = F.col("optimal_total_revenue") - F.col("baseline_total_revenue")
    error = F.abs(F.col("budget_allocated") - F.col("total_budget"))
    return sums.select(
        "total_budget",
        "baseline_total_revenue",
        "optimal_total_revenue",
        lift.alias("revenue_lift"),
        F.when(F.col("baseline_total_revenue") > 0, lift / F.col("baseline_total_revenue") * 100.0)
        .otherwise(F.lit(0.0)).alias("revenue_lift_pct"),
        ratio0("baseline_total_revenue", "_base").alias("baseline_roas"),
        ratio0("optimal_total_revenue", "budget_allocated").alias("optimal_roas"),
        weighted_risk("total_budget", "_sat", "_unreliable", "_squares").alias("risk_score"),
        (F.lit(feasible) & (error <= F.col("total_budget") * 1e-6)).alias("converged"),
        F.lit(rounds).alias("n_iterations"),
        F.lit("budget outside the spend bounds" if not feasible else "optimal" if gap <= OPTIMAL_GAP
              else f"within {gap:.1e} of the upper bound").alias("solver_message"),
        "budget_allocated",
        error.alias("budget_error"),
    )

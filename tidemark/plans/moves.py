"""Everything built on an allocation, over one that SQL can state: fixed moves of the fitted curves' spends.

The twins' sentences are filled from the same templates as the operators' (``functions.messages``).
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import functions as F

from tidemark.functions import messages as M
from tidemark.operators import allocate as A
from tidemark.operators import recommend as N
from tidemark.operators import reports as R
from tidemark.plans import response as C
from tidemark.plans.forecasts import _n0, _title
from tidemark.plans.registry import query
from tidemark.session import cut_lineage

#: What campaigns spend afterwards, by id modulo four, as a share of what they spent.
FACTORS = (1.4, 0.6, 1.0, 1.2)


def sql_fill(template: str, **values: str) -> str:
    """A template of messages as an SQL expression over the given ones."""
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append("'" + literal.replace("'", "''") + "'")
        if name:
            parts.append(f"CAST({values[name]} AS VARCHAR)")
    return "(" + " || ".join(parts) + ")"


def _fixed(x: str, digits: int = 1, signed: bool = False) -> str:
    return f"printf('%{'+' if signed else ''}.{digits}f', CAST({x} AS DOUBLE))"


def _percent(x: str) -> str:
    return f"({_fixed(f'{x} * 100', 0)} || '%')"


_FACTOR = "CASE campaign_id % 4 " + " ".join(f"WHEN {i} THEN CAST({f} AS DOUBLE)" for i, f in enumerate(FACTORS)) + " END"
ALLOCATION_SQL = f"""{C.CURVES_SQL}, moved AS (SELECT *, avg_daily_spend AS x0, avg_daily_spend * {_FACTOR} AS x FROM curves
), alloc AS (
  SELECT campaign_id, campaign_name, platform, x0 AS baseline_spend, x AS optimal_spend, x - x0 AS spend_delta,
    CASE WHEN x0 > 0 THEN (x - x0) / x0 * 100 ELSE 0 END AS spend_delta_pct, avg_daily_revenue AS baseline_revenue,
    r AS optimal_revenue, r - avg_daily_revenue AS revenue_delta,
    CASE WHEN avg_daily_revenue > 0 THEN (r - avg_daily_revenue) / avg_daily_revenue * 100 ELSE 0 END AS revenue_delta_pct,
    {C.slope_sql('x0')} AS baseline_marginal_roas, {C.slope_sql('x')} AS optimal_marginal_roas,
    CASE WHEN x > 0 AND v_max > 0 THEN 1 / (1 + pow(x / k, -n)) ELSE 0 END AS saturation_at_optimal, is_reliable
  FROM (SELECT *, {C.hill_sql('x')} AS r FROM moved))"""
MOVES_SQL = f"""{ALLOCATION_SQL}, advice AS (
  SELECT CASE WHEN spend_delta > 0 THEN 'increase_budget' ELSE 'decrease_budget' END AS type,
    CASE WHEN spend_delta > 0 AND revenue_delta_pct > 5 THEN 'high' ELSE 'medium' END AS priority,
    CASE WHEN spend_delta > 0
      THEN {sql_fill(M.INCREASE_TITLE, platform=_title('platform'), id='campaign_id', amount=_n0('abs(spend_delta)'), pct=_fixed('spend_delta_pct', 0))}
      ELSE {sql_fill(M.DECREASE_TITLE, platform=_title('platform'), id='campaign_id', amount=_n0('abs(spend_delta)'), pct=_fixed('spend_delta_pct', 0))}
    END AS title,
    CASE WHEN spend_delta > 0
      THEN {sql_fill(M.INCREASE_TEXT, lift=_n0('revenue_delta'), lift_pct=_fixed('revenue_delta_pct'), mroas=_fixed('optimal_marginal_roas', 2), sat=_percent('saturation_at_optimal'))}
      ELSE {sql_fill(M.DECREASE_TEXT, state="CASE WHEN saturation_at_optimal > 0.75 THEN 'saturated' ELSE 'over-budgeted' END", amount=_n0('abs(spend_delta)'), lift_pct=_fixed('revenue_delta_pct', signed=True))}
    END AS rationale,
    revenue_delta AS expected_revenue_lift, revenue_delta_pct AS expected_revenue_lift_pct, CAST(NULL AS VARCHAR) AS source_campaign_id,
    CAST(campaign_id AS VARCHAR) AS target_campaign_id, spend_delta AS spend_change, baseline_marginal_roas,
    optimal_marginal_roas AS target_marginal_roas
  FROM alloc WHERE abs(spend_delta) >= 10 AND (baseline_spend <= 0 OR abs(spend_delta) >= baseline_spend * 0.05)
), sources AS (
  SELECT row_number() OVER (ORDER BY abs(spend_change) DESC, target_campaign_id) AS rk, target_campaign_id AS src, abs(spend_change) AS freed,
    baseline_marginal_roas AS src_mroas, abs(expected_revenue_lift) AS src_lift, abs(expected_revenue_lift_pct) AS src_lift_pct
  FROM advice WHERE type = 'decrease_budget' ORDER BY rk LIMIT 3
), goals AS (
  SELECT row_number() OVER (ORDER BY target_marginal_roas DESC, target_campaign_id) AS rk, target_campaign_id AS dst, spend_change AS wanted,
    target_marginal_roas AS dst_mroas, expected_revenue_lift AS dst_lift, expected_revenue_lift_pct AS dst_lift_pct
  FROM advice WHERE type = 'increase_budget' ORDER BY rk LIMIT 3
), pairs AS (
  SELECT 'reallocate' AS type, 'high' AS priority,
    {sql_fill(M.MOVE_TITLE, amount=_n0('amount'), source='src', target='dst')} AS title,
    {sql_fill(M.MOVE_TEXT, target='dst', target_mroas=_fixed('dst_mroas', 2), source='src', source_mroas=_fixed('src_mroas', 2), amount=_n0('amount'), lift=_fixed('lift', 0))} AS rationale,
    lift AS expected_revenue_lift, (dst_lift_pct + src_lift_pct) / 2 AS expected_revenue_lift_pct, src AS source_campaign_id,
    dst AS target_campaign_id, amount AS spend_change, src_mroas AS baseline_marginal_roas, dst_mroas AS target_marginal_roas
  FROM (SELECT *, least(freed, wanted) AS amount, dst_lift + src_lift AS lift FROM sources JOIN goals USING (rk))
  WHERE dst_mroas - src_mroas >= 0.2 AND amount >= 10)"""


def allocation(spark, d):
    """An allocation table of fixed moves."""
    factor = F.element_at(F.array(*map(F.lit, FACTORS)), (F.col("campaign_id") % 4 + 1).cast("int"))
    return cut_lineage(A.allocation_table(C.curves(spark, d).withColumn("optimal_spend", F.col("avg_daily_spend") * factor)))


_TABLE = ["baseline_spend", "optimal_spend", "spend_delta", "spend_delta_pct", "baseline_revenue", "optimal_revenue", "revenue_delta",
          "revenue_delta_pct", "baseline_marginal_roas", "optimal_marginal_roas", "saturation_at_optimal"]
_KEYS = ["type", "priority", "title", "rationale", "source_campaign_id", "target_campaign_id"]
_DOUBLES = ["expected_revenue_lift", "expected_revenue_lift_pct", "spend_change", "baseline_marginal_roas", "target_marginal_roas"]


@query("moves_table", ["campaign_id", "campaign_name", "platform", "is_reliable"], _TABLE, ctes=ALLOCATION_SQL, source="alloc", digits=3)
def moves_table(spark, d):
    return allocation(spark, d)


@query("moves_summary", ["converged", "solver_message"],
       ["total_budget", "baseline_total_revenue", "optimal_total_revenue", "revenue_lift", "revenue_lift_pct", "baseline_roas",
        "optimal_roas", "risk_score", "budget_allocated", "budget_error"], ctes=ALLOCATION_SQL, digits=3, source="""(
    SELECT s * 1.05 AS total_budget, b AS baseline_total_revenue, o AS optimal_total_revenue, o - b AS revenue_lift,
      (o - b) / b * 100 AS revenue_lift_pct, b / s AS baseline_roas, o / a AS optimal_roas,
      least(1.0, greatest(0.0, 0.5 * sat / (s * 1.05) + 0.35 * loose / (s * 1.05) + 0.15 * sq / ((s * 1.05) * (s * 1.05)))) AS risk_score,
      abs(a - s * 1.05) <= s * 1.05e-6 AS converged, 'optimal' AS solver_message, a AS budget_allocated, abs(a - s * 1.05) AS budget_error
    FROM (SELECT sum(baseline_spend) AS s, sum(baseline_revenue) AS b, sum(optimal_revenue) AS o, sum(optimal_spend) AS a,
      sum(optimal_spend * saturation_at_optimal) AS sat, sum(CASE WHEN is_reliable THEN 0 ELSE optimal_spend END) AS loose,
      sum(optimal_spend * optimal_spend) AS sq FROM alloc))""")
def moves_summary(spark, d):
    table = allocation(spark, d)
    budget = table.agg(F.sum("baseline_spend")).first()[0] * 1.05
    return A.allocation_summary(table, budget)


@query("moves_display", ["campaign_id", "platform"],
       ["current_spend", "optimal_spend", "spend_change", "spend_change_pct", "revenue_lift", "saturation"], ctes=ALLOCATION_SQL, digits=2,
       source=f"""(SELECT campaign_id, {_title('platform')} AS platform, round(baseline_spend, 0) AS current_spend,
         round(optimal_spend, 0) AS optimal_spend, round(spend_delta, 0) AS spend_change, round(spend_delta_pct, 1) AS spend_change_pct,
         round(revenue_delta, 0) AS revenue_lift, round(saturation_at_optimal, 2) AS saturation FROM alloc WHERE abs(spend_delta) > 0.5)""")
def moves_display(spark, d):
    return R.allocation_display(allocation(spark, d))


@query("moves_advice", _KEYS, _DOUBLES, ctes=MOVES_SQL, source="advice", digits=3)
def moves_advice(spark, d):
    return N.from_allocations(allocation(spark, d))


@query("moves_pairs", _KEYS, _DOUBLES, ctes=MOVES_SQL, source="pairs", digits=3)
def moves_pairs(spark, d):
    return N.reallocation_pairs(cut_lineage(N.from_allocations(allocation(spark, d))))


@query("moves_recommendations", _KEYS, _DOUBLES, ctes=MOVES_SQL, digits=3, source="""(
    SELECT * FROM (SELECT * FROM advice UNION ALL SELECT * FROM pairs)
    ORDER BY CASE priority WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, expected_revenue_lift DESC, type, target_campaign_id LIMIT 5)""")
def moves_recommendations(spark, d):
    return N.recommendations(allocation(spark, d))

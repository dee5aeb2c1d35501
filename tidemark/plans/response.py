"""Response curves on the fixed grid, portfolio reports, scenarios, curve risks, recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import curves as C
from tidemark.operators import context as X
from tidemark.operators import recommend as N
from tidemark.operators import reports as R
from tidemark.operators import response as P
from tidemark.operators import risks as K
from tidemark.operators import scenarios as S
from tidemark.operators.features import budget_features
from tidemark.plans import tables as V
from tidemark.plans.forecasts import (
    CI_RISK_SQL, RECENT_SQL, RISK_DOUBLES, RISK_KEYS, UTILIZATION_SQL, ZERO_SQL, _n0, _title,
)
from tidemark.plans.registry import query
from tidemark.session import cut_lineage

# ---- curves -----------------------------------------------------------------------------------------

_GRID_SQL = ", ".join(f"({k!r}, {n!r})" for k in P.COARSE_K for n in P.COARSE_N)

HILL_SQL = f"""clean AS (
  SELECT campaign_id, spend AS s, revenue_attributed AS r FROM facts
  WHERE attribution_mature AND spend >= 0 AND revenue_attributed >= 0
), stats AS (
  SELECT campaign_id, count(*) FILTER (s > 0) AS n_points, avg(s) FILTER (s > 0) AS spend_mean,
    stddev_pop(s) FILTER (s > 0) AS spend_std, max(s) AS max_spend,
    greatest(max(r) FILTER (s > 0), 1.0) AS max_revenue,
    var_pop(r) FILTER (s > 0) * count(*) FILTER (s > 0) AS ss_total, sum(s) AS sum_spend, sum(r) AS sum_revenue
  FROM clean GROUP BY campaign_id
), grid(kr, n) AS (VALUES {_GRID_SQL}
), sums AS (
  SELECT campaign_id, kr, n, any_value(max_revenue) AS mr, sum(h * h) AS hh, sum(r * h) AS rh, sum(r * r) AS rr
  FROM (SELECT c.campaign_id, r, max_revenue, kr, n, 1 / (1 + pow(s / (kr * max_spend), -n)) AS h
        FROM clean c JOIN stats t ON c.campaign_id = t.campaign_id, grid
        WHERE s > 0 AND n_points >= 8 AND spend_std >= spend_mean * 0.05)
  GROUP BY campaign_id, kr, n
), best AS (
  SELECT campaign_id, kr, n, v_max, rr - 2 * v_max * rh + v_max * v_max * hh AS sse
  FROM (SELECT *, least(greatest(coalesce(rh / hh, 0), mr * 0.1), mr * 5.0) AS v_max FROM sums)
  QUALIFY row_number() OVER (PARTITION BY campaign_id ORDER BY sse, kr, n) = 1
), fit0 AS (
  SELECT t.*, b.kr, b.n AS bn, b.v_max AS bv, b.sse, greatest(max_spend * 1000, 1e6) AS line_k,
    greatest(CASE WHEN sum_spend > 0 THEN sum_revenue / sum_spend ELSE 1 END, 0) AS line_roas,
    CASE WHEN ss_total = 0 THEN 1.0 ELSE least(1.0, greatest(-1.0, 1 - sse / ss_total)) END AS r2
  FROM stats t LEFT JOIN best b USING (campaign_id)
), fit AS (
  SELECT campaign_id, n_points,
    CASE WHEN sse IS NOT NULL THEN bv ELSE line_k * line_roas END AS v_max,
    CASE WHEN sse IS NOT NULL THEN kr * max_spend ELSE line_k END AS k,
    CASE WHEN sse IS NOT NULL THEN bn ELSE 1.0 END AS n,
    CASE WHEN sse IS NOT NULL THEN r2 ELSE 0.0 END AS r_squared,
    sse IS NOT NULL AND r2 >= 0.25 AS is_reliable,
    CASE WHEN sse IS NULL THEN CASE WHEN n_points < 8
           THEN 'linear fallback: too few nonzero points (' || n_points || ')'
           ELSE 'linear fallback: spend variance too low' END
         WHEN r2 >= 0.25 THEN 'ok' ELSE 'low R² (' || printf('%.3f', r2) || ')' END AS fit_reason
  FROM fit0
)"""

CURVES_SQL = f"""{V.FACTS_SQL}, {HILL_SQL}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY attribution_mature DESC, date DESC) AS rk FROM facts
), points AS (
  SELECT campaign_id, any_value(platform) AS platform, any_value(campaign_name) AS campaign_name,
    count(*) FILTER (attribution_mature) AS n_training_rows,
    greatest(coalesce(avg(spend) FILTER (rk <= 30 AND attribution_mature), 0), 0) AS avg_daily_spend,
    greatest(coalesce(avg(revenue_attributed) FILTER (rk <= 30 AND attribution_mature), 0), 0) AS avg_daily_revenue
  FROM ranked GROUP BY campaign_id
), curves0 AS (
  SELECT * FROM points JOIN fit USING (campaign_id)
), curves AS (
  SELECT *, CASE WHEN avg_daily_spend > 0 AND v_max > 0 THEN 1 / (1 + pow(avg_daily_spend / k, -n)) ELSE 0 END AS saturation_score,
    CASE WHEN avg_daily_spend > 0 THEN v_max * n * pow(avg_daily_spend / k, n) /
      (avg_daily_spend * pow(1 + pow(avg_daily_spend / k, n), 2)) ELSE v_max * n / k END AS current_marginal_roas,
    CASE WHEN avg_daily_spend > 0 THEN avg_daily_revenue / avg_daily_spend ELSE 0 END AS current_roas
  FROM curves0
)"""


def curves(spark, d):
    """Curves of the fixed grid: the form both engines can compute exactly."""
    return P.response_curves(V.stored_facts(spark, d), refinements=0)


def hill_sql(x):
    return f"CASE WHEN {x} > 0 THEN v_max / (1 + pow({x} / k, -n)) ELSE 0 END"


def slope_sql(x):
    return (f"CASE WHEN {x} > 0 THEN v_max * n * pow({x} / k, n) / ({x} * pow(1 + pow({x} / k, n), 2)) "
            "ELSE v_max * n / k END")


@query("current_spend_revenue", ["platform", "campaign_id", "campaign_name", "n_training_rows"],
       ["avg_daily_spend", "avg_daily_revenue"], source="points", ctes=CURVES_SQL)
def current_spend_revenue(spark, d):
    return P.operating_points(V.stored_facts(spark, d))


@query("fit_statistics", ["campaign_id", "n_points"],
       ["spend_mean", "spend_std", "max_spend", "max_revenue", "sum_spend", "sum_revenue"], digits=3,
       ctes=f"{V.FACTS_SQL}, {HILL_SQL}", source="stats")
def fit_statistics(spark, d):
    return P.fit_statistics(V.facts(spark, d))


_FIT_KEYS = ["campaign_id", "n_points", "is_reliable", "fit_reason"]


@query("fit_hill_grid", _FIT_KEYS, ["v_max", "k", "n", "r_squared"], ctes=f"{V.FACTS_SQL}, {HILL_SQL}", source="fit")
def fit_hill_grid(spark, d):
    return P.fit_hill(V.stored_facts(spark, d), refinements=0)


@query("response_curves", ["campaign_id", "campaign_name", "platform", "is_reliable", "fit_reason", "n_points", "n_training_rows"],
       ["v_max", "k", "n", "r_squared", "avg_daily_spend", "avg_daily_revenue", "saturation_score",
        "current_marginal_roas", "current_roas"], ctes=CURVES_SQL, source="curves")
def response_curves(spark, d):
    return curves(spark, d)


@query("fit_hill", _FIT_KEYS, ["v_max", "k", "n", "r_squared"])
def fit_hill(spark, d):
    """The refined fit; its invariants are in the tests."""
    return P.fit_hill(V.stored_facts(spark, d))


@query("hill_on_facts", ["campaign_id", "date"], ["fitted", "slope", "sat"], ctes=f"{V.FACTS_SQL}, {HILL_SQL}",
       source=f"(SELECT campaign_id, date, {hill_sql('spend')} AS fitted, {slope_sql('spend')} AS slope, "
              "CASE WHEN spend > 0 AND v_max > 0 THEN 1 / (1 + pow(spend / k, -n)) ELSE 0 END AS sat "
              "FROM facts JOIN fit USING (campaign_id))")
def hill_on_facts(spark, d):
    """Every fact row evaluated on its campaign's curve."""
    rows = V.stored_facts(spark, d)
    return rows.join(P.fit_hill(rows, refinements=0), "campaign_id").select(
        "campaign_id", "date", C.hill("spend").alias("fitted"), C.marginal_roas("spend").alias("slope"),
        C.saturation("spend").alias("sat"))


@query("spend_for_saturation", ["campaign_id"], ["at_50", "at_80", "at_all"], ctes=CURVES_SQL, digits=2,
       source="(SELECT campaign_id, k AS at_50, k * pow(4.0, 1 / n) AS at_80, "
              "k * pow((1 - 1e-6) / (1 - (1 - 1e-6)), 1 / n) / 1e6 AS at_all FROM curves)")
def spend_for_saturation(spark, d):
    return curves(spark, d).select(
        "campaign_id", C.spend_for_saturation(0.5).alias("at_50"), C.spend_for_saturation(0.8).alias("at_80"),
        (C.spend_for_saturation(1.0) / 1e6).alias("at_all"))


@query("project", ["campaign_id"], ["projected", "lift_pct"], ctes=CURVES_SQL,
       source=f"(SELECT campaign_id, {hill_sql('(avg_daily_spend * 1.25)')} AS projected, "
              f"(({hill_sql('(avg_daily_spend * 1.25)')}) - avg_daily_revenue) / avg_daily_revenue * 100 AS lift_pct FROM curves)")
def project(spark, d):
    projected = C.hill(F.col("avg_daily_spend") * 1.25)
    return curves(spark, d).select(
        "campaign_id", projected.alias("projected"), C.lift_pct(projected, "avg_daily_revenue").alias("lift_pct"))


# ---- portfolio reports ----------------------------------------------------------------------------------


@query("portfolio_kpis", ["n_campaigns", "n_saturated", "n_headroom"],
       ["total_daily_spend", "total_daily_revenue", "blended_roas"], ctes=CURVES_SQL, digits=3, source="""(
    SELECT count(*) AS n_campaigns, count(*) FILTER (saturation_score >= 0.75) AS n_saturated,
      count(*) FILTER (saturation_score < 0.4) AS n_headroom, sum(avg_daily_spend) AS total_daily_spend,
      sum(avg_daily_revenue) AS total_daily_revenue, sum(avg_daily_revenue) / sum(avg_daily_spend) AS blended_roas
    FROM curves)""")
def portfolio_kpis(spark, d):
    return R.portfolio_kpis(curves(spark, d))


@query("platform_comparison", ["platform", "campaigns", "reliable_curves"],
       ["daily_spend", "daily_revenue", "roas", "avg_saturation_pct", "avg_marginal_roas"], ctes=CURVES_SQL,
       source=f"""(SELECT {_title('platform')} AS platform, count(*) AS campaigns,
      count(*) FILTER (is_reliable) AS reliable_curves, round(sum(avg_daily_spend), 0) AS daily_spend,
      round(sum(avg_daily_revenue), 0) AS daily_revenue, round(sum(avg_daily_revenue) / sum(avg_daily_spend), 2) AS roas,
      round(avg(saturation_score) * 100, 1) AS avg_saturation_pct, round(avg(current_marginal_roas), 2) AS avg_marginal_roas
      FROM curves GROUP BY curves.platform)""")
def platform_comparison(spark, d):
    return R.platform_comparison(curves(spark, d))


@query("segment_table", ["platform", "segment", "campaigns"],
       ["daily_spend", "daily_revenue", "avg_roas", "avg_marginal_roas", "avg_saturation"], ctes=CURVES_SQL, digits=2,
       source="""(SELECT platform, CASE WHEN contains(upper(campaign_name), '_TM_') OR contains(upper(campaign_name), 'BRAND')
      THEN 'TM' ELSE 'NTM' END AS segment, count(*) AS campaigns, sum(avg_daily_spend) AS daily_spend,
      sum(avg_daily_revenue) AS daily_revenue, avg(current_roas) AS avg_roas,
      avg(current_marginal_roas) AS avg_marginal_roas, avg(saturation_score) AS avg_saturation
      FROM curves GROUP BY 1, 2)""")
def segment_table(spark, d):
    return R.segment_table(curves(spark, d), "campaign_name")


@query("campaign_table", ["campaign_id", "campaign_name", "platform", "is_reliable", "segment"],
       ["avg_daily_spend", "avg_daily_revenue", "current_roas", "marginal_roas", "saturation_pct", "r_squared",
        "forecast_rev_7d"], digits=2, ctes=f"{RECENT_SQL}, {CURVES_SQL.split(V.FACTS_SQL + ', ', 1)[1]}",
       source="""(SELECT campaign_id, campaign_name, platform, is_reliable, avg_daily_spend, avg_daily_revenue, current_roas,
      current_marginal_roas AS marginal_roas, round(saturation_score * 100, 1) AS saturation_pct, r_squared,
      CASE WHEN contains(upper(campaign_name), '_TM_') OR contains(upper(campaign_name), 'BRAND') THEN 'TM' ELSE 'NTM' END AS segment,
      forecast_rev_7d FROM curves LEFT JOIN
      (SELECT campaign_id, sum(p50) AS forecast_rev_7d FROM recent GROUP BY campaign_id) USING (campaign_id))""")
def campaign_table(spark, d):
    rows = V.stored_facts(spark, d)
    return R.campaign_table(P.response_curves(rows, refinements=0), V.forecast(spark, d, rows), 7, "campaign_name")


@query("join_forecast_revenue", ["campaign_id"], ["avg_daily_revenue", "forecast_rev_7d"], digits=3,
       ctes=f"{RECENT_SQL}, {CURVES_SQL.split(V.FACTS_SQL + ', ', 1)[1]}",
       source="""(SELECT campaign_id, avg_daily_revenue, forecast_rev_7d FROM points LEFT JOIN
      (SELECT campaign_id, sum(p50) AS forecast_rev_7d FROM recent GROUP BY campaign_id) USING (campaign_id))""")
def join_forecast_revenue(spark, d):
    rows = V.stored_facts(spark, d)
    return P.operating_points(rows).join(R.forecast_revenue(V.forecast(spark, d, rows)), "campaign_id", "left")


# ---- scenarios ----------------------------------------------------------------------------------------------

_SCENARIO_ROWS = ", ".join(
    f"('{s.name}', '{p}', {s.multipliers.get(p, 1.0)!r})" for s in S.STANDARD_SCENARIOS for p in V.PLATFORMS)
SCENARIO_SQL = f"""{CURVES_SQL}, multipliers(scenario, platform, m) AS (VALUES {_SCENARIO_ROWS}
), planned AS (
  SELECT *, avg_daily_spend * m AS x FROM curves JOIN multipliers USING (platform)
), projections AS (
  SELECT scenario, campaign_id, campaign_name, platform, avg_daily_spend AS baseline_daily_spend, x AS new_daily_spend,
    x - avg_daily_spend AS spend_delta,
    CASE WHEN avg_daily_spend > 0 THEN (x - avg_daily_spend) / avg_daily_spend * 100 ELSE 0 END AS spend_delta_pct,
    avg_daily_revenue AS baseline_daily_revenue, pr AS projected_daily_revenue, pr - avg_daily_revenue AS revenue_delta,
    CASE WHEN avg_daily_revenue > 0 THEN (pr - avg_daily_revenue) / avg_daily_revenue * 100 ELSE 0 END AS revenue_delta_pct,
    current_marginal_roas AS baseline_marginal_roas, {slope_sql('x')} AS new_marginal_roas,
    CASE WHEN x > 0 AND v_max > 0 THEN 1 / (1 + pow(x / k, -n)) ELSE 0 END AS sat, r_squared, is_reliable
  FROM (SELECT *, CASE WHEN abs(x - avg_daily_spend) < 1e-9 THEN avg_daily_revenue ELSE {hill_sql('x')} END AS pr FROM planned)
), summary AS (
  SELECT scenario, b AS baseline_revenue, p AS projected_revenue, p - b AS revenue_lift, (p - b) / b * 100 AS revenue_lift_pct,
    bs AS baseline_spend, t AS new_spend, b / bs AS baseline_roas, p / t AS projected_roas,
    greatest(0, p - p * u * 1.28) AS ci_low, p + p * u * 1.28 AS ci_high,
    least(1.0, greatest(0.0, 0.5 * rs + 0.35 * rr + 0.15 * rc)) AS risk_score
  FROM (SELECT scenario, any_value(t) AS t, sum(baseline_daily_revenue) AS b, sum(projected_daily_revenue) AS p,
      sum(baseline_daily_spend) AS bs,
      sum(new_daily_spend / t * (1 - CASE WHEN is_reliable THEN r_squared ELSE 0 END) * 0.35) AS u,
      sum(new_daily_spend / t * sat) AS rs, sum(CASE WHEN is_reliable THEN 0 ELSE new_daily_spend / t END) AS rr,
      sum(pow(new_daily_spend / t, 2)) AS rc
    FROM projections JOIN (SELECT scenario, sum(new_daily_spend) AS t FROM projections GROUP BY scenario) USING (scenario)
    GROUP BY scenario)
)"""
_PROJECTION_DOUBLES = [c for c in S.PROJECTION_COLUMNS if c not in ("scenario", "campaign_id", "campaign_name", "platform")]


@query("apply_scenario", ["scenario", "campaign_id", "campaign_name", "platform"], _PROJECTION_DOUBLES,
       ctes=SCENARIO_SQL, source="projections")
def apply_scenario(spark, d):
    return S.project_spend(curves(spark, d), S.STANDARD_SCENARIOS)


_SUMMARY_DOUBLES = ["baseline_revenue", "projected_revenue", "revenue_lift", "revenue_lift_pct", "baseline_spend",
                    "new_spend", "baseline_roas", "projected_roas", "ci_low", "ci_high", "risk_score"]


@query("standard_scenarios", ["scenario"], _SUMMARY_DOUBLES, ctes=SCENARIO_SQL, source="summary", digits=3)
def standard_scenarios(spark, d):
    return S.standard_scenarios(curves(spark, d))


@query("scenario_overrides", ["scenario", "campaign_id"], ["new_daily_spend", "projected_daily_revenue", "revenue_delta"],
       ctes=CURVES_SQL, source=f"""(SELECT 'Custom' AS scenario, campaign_id, x AS new_daily_spend, pr AS projected_daily_revenue,
      pr - avg_daily_revenue AS revenue_delta FROM (
        SELECT *, CASE WHEN abs(x - avg_daily_spend) < 1e-9 THEN avg_daily_revenue ELSE {hill_sql('x')} END AS pr
        FROM (SELECT *, greatest(coalesce(o, avg_daily_spend * CASE WHEN platform = 'meta' THEN 1.5 ELSE 1.0 END), 0) AS x
          FROM curves LEFT JOIN (SELECT s_suppkey AS campaign_id, s_acctbal / 4 AS o FROM supplier WHERE s_acctbal < 2000)
          USING (campaign_id))))""")
def scenario_overrides(spark, d):
    """Multipliers with an override table as large as the data wants it to be."""
    wanted = V.table(spark, d, "supplier").filter("s_acctbal < 2000").select(
        F.lit("Custom").alias("scenario"), F.col("s_suppkey").alias("campaign_id"),
        (F.col("s_acctbal") / 4).alias("override_spend"))
    return S.project_spend(curves(spark, d), [S.Scenario("Custom", "", {"meta": 1.5})], wanted)


@query("before_after", ["scenario", "platform"], ["baseline", "projected"], ctes=SCENARIO_SQL, digits=3,
       source="(SELECT scenario, platform, sum(baseline_daily_revenue) AS baseline, "
              "sum(projected_daily_revenue) AS projected FROM projections GROUP BY scenario, platform)")
def before_after(spark, d):
    return R.before_after(S.project_spend(curves(spark, d), S.STANDARD_SCENARIOS))


@query("waterfall", ["label", "measure"], ["spend_delta", "baseline", "new_spend"], ctes=SCENARIO_SQL, digits=3,
       source=f"""(SELECT CASE WHEN grouping(platform) = 1 THEN 'Total Change' ELSE {_title('platform')} END AS label,
      CASE WHEN grouping(platform) = 1 THEN 'total' ELSE 'relative' END AS measure, sum(spend_delta) AS spend_delta,
      sum(baseline_daily_spend) AS baseline, sum(new_daily_spend) AS new_spend
      FROM projections WHERE scenario = 'Google Boost' GROUP BY ROLLUP (platform))""")
def waterfall(spark, d):
    return R.waterfall(S.apply_scenario(curves(spark, d), S.STANDARD_SCENARIOS[1]))


@query("top_movers", ["campaign_id", "platform"],
       ["baseline_marginal_roas", "new_marginal_roas", "spend_delta_pct", "abs_delta", "bubble_size"], ctes=SCENARIO_SQL,
       source="""(SELECT campaign_id, platform, baseline_marginal_roas, new_marginal_roas, spend_delta_pct,
      abs(spend_delta_pct) AS abs_delta, greatest(abs(spend_delta_pct), 6.0) AS bubble_size
      FROM projections WHERE scenario = 'Google Boost' ORDER BY round(abs(spend_delta_pct), 6) DESC, campaign_id LIMIT 15)""")
def top_movers(spark, d):
    moves = S.apply_scenario(curves(spark, d), S.STANDARD_SCENARIOS[1])
    return R.top_movers(moves.withColumn("spend_delta_pct", F.round("spend_delta_pct", 6)))


@query("projection_display", ["scenario", "campaign_id", "platform"],
       ["baseline_spend", "new_spend", "baseline_revenue", "projected_revenue", "revenue_lift_pct"], ctes=SCENARIO_SQL,
       source=f"""(SELECT scenario, campaign_id, {_title('platform')} AS platform, round(baseline_daily_spend, 0) AS baseline_spend,
      round(new_daily_spend, 0) AS new_spend, round(baseline_daily_revenue, 0) AS baseline_revenue,
      round(projected_daily_revenue, 0) AS projected_revenue, round(revenue_delta_pct, 1) AS revenue_lift_pct FROM projections)""")
def projection_display(spark, d):
    return R.projection_display(S.project_spend(curves(spark, d), S.STANDARD_SCENARIOS))


# ---- risks on curves ---------------------------------------------------------------------------------------

SATURATION_SQL = f"""(SELECT 'saturation' AS type, CASE WHEN z >= 0.9 THEN 'critical' ELSE 'high' END AS severity,
  {_title('platform')} || ' · ' || campaign_id || ': saturation ' || printf('%.0f', z * 100) || '%' AS title,
  'Campaign ''' || campaign_id || ''' (' || platform || ') is at ' || printf('%.0f', z * 100) ||
    '% saturation (Hill curve saturation score). Marginal ROAS at current spend $' || {_n0('avg_daily_spend')} || '/day = $' ||
    printf('%.2f', current_marginal_roas) || 'x, well below average ROAS of $' || printf('%.2f', current_roas) || 'x.' AS explanation,
  'saturation_score' AS metric_name, z AS metric_value, 0.75 AS threshold,
  CAST(campaign_id AS VARCHAR) AS campaign_id, platform,
  CASE WHEN z >= 0.9 THEN 'Campaign ''' || campaign_id || ''' is effectively saturated. Further spend increases will yield negligible revenue gains. Reallocate budget to lower-saturation campaigns.'
    ELSE 'Campaign ''' || campaign_id || ''' is approaching saturation. Marginal ROAS is $' || printf('%.2f', current_marginal_roas) ||
      ' vs average ROAS $' || printf('%.2f', current_roas) || '.' END AS recommendation
  FROM (SELECT *, saturation_score AS z FROM curves) WHERE z >= 0.75)"""
CONCENTRATION_SQL = f"""(SELECT 'spend_concentration' AS type, 'medium' AS severity,
  {_title('platform')} || ' receives ' || printf('%.0f', h * 100) || '% of total spend' AS title,
  {_title('platform')} || ' accounts for $' || {_n0('s')} || '/day out of $' || {_n0('t')} || '/day total (' || printf('%.0f', h * 100) ||
    '%). High concentration creates single-point-of-failure risk if platform performance declines.' AS explanation,
  'platform_spend_share' AS metric_name, h * 100 AS metric_value, 50.0 AS threshold,
  CAST(NULL AS VARCHAR) AS campaign_id, platform,
  'Diversify budget across platforms to reduce dependency on ' || {_title('platform')} || '.' AS recommendation
  FROM (SELECT platform, s, t, s / t AS h FROM (SELECT platform, sum(avg_daily_spend) AS s FROM curves GROUP BY platform),
        (SELECT sum(avg_daily_spend) AS t FROM curves)) WHERE h > 0.5)"""


def _risk(name, source, ctes, build):
    query(name, RISK_KEYS, RISK_DOUBLES, source=source, ctes=ctes)(build)


_risk("saturation_risk", SATURATION_SQL, CURVES_SQL, lambda s, d: K.saturation_risk(curves(s, d)))
_risk("concentration_risk", CONCENTRATION_SQL, CURVES_SQL, lambda s, d: K.concentration_risk(cut_lineage(curves(s, d))))


def _all_risks(spark, d):
    rows = V.stored_facts(spark, d)
    return K.all_risks(budget_features(rows), cut_lineage(P.response_curves(rows, refinements=0)), V.forecast(spark, d, rows))


_risk("all_risks", "(" + " UNION ALL ".join(
    f"SELECT * FROM {q}" for q in (UTILIZATION_SQL, ZERO_SQL, SATURATION_SQL, CONCENTRATION_SQL, CI_RISK_SQL)) + ")",
    f"{RECENT_SQL}, {CURVES_SQL.split(V.FACTS_SQL + ', ', 1)[1]}", _all_risks)

# ---- recommendations and context ------------------------------------------------------------------------------


@query("quick_recommendations", ["type", "priority", "source_campaign_id", "target_campaign_id"],
       ["expected_revenue_lift", "expected_revenue_lift_pct", "spend_change", "baseline_marginal_roas", "target_marginal_roas"],
       ctes=CURVES_SQL, source=f"""(
    SELECT * FROM (
      SELECT 'increase_budget' AS type, 'high' AS priority, CAST(NULL AS VARCHAR) AS source_campaign_id,
        CAST(campaign_id AS VARCHAR) AS target_campaign_id, ({hill_sql('(avg_daily_spend * 1.15)')}) - avg_daily_revenue AS expected_revenue_lift,
        (({hill_sql('(avg_daily_spend * 1.15)')}) - avg_daily_revenue) / avg_daily_revenue * 100 AS expected_revenue_lift_pct,
        avg_daily_spend * 0.15 AS spend_change, current_marginal_roas AS baseline_marginal_roas,
        {slope_sql('(avg_daily_spend * 1.15)')} AS target_marginal_roas
      FROM (SELECT * FROM curves ORDER BY current_marginal_roas DESC, campaign_id LIMIT 3)
      WHERE saturation_score <= 0.8 AND avg_daily_spend * 0.15 >= 10
      UNION ALL
      SELECT 'decrease_budget', 'medium', CAST(campaign_id AS VARCHAR), NULL,
        ({hill_sql('(avg_daily_spend * 0.85)')}) - avg_daily_revenue,
        (({hill_sql('(avg_daily_spend * 0.85)')}) - avg_daily_revenue) / avg_daily_revenue * 100,
        -avg_daily_spend * 0.15, current_marginal_roas, 0.0
      FROM (SELECT * FROM curves ORDER BY current_marginal_roas, campaign_id DESC LIMIT 3)
      WHERE avg_daily_spend >= 20 AND avg_daily_spend * 0.15 >= 10)
    ORDER BY expected_revenue_lift DESC LIMIT 5)""")
def quick_recommendations(spark, d):
    return N.quick_recommendations(cut_lineage(curves(spark, d)))


@query("campaign_buckets", ["campaign_id", "bucket"], ctes=CURVES_SQL, source="""(
    SELECT campaign_id, 'saturated' AS bucket FROM curves WHERE saturation_score >= 0.75
    UNION ALL SELECT campaign_id, 'has_headroom' FROM curves WHERE saturation_score < 0.4
    UNION ALL SELECT campaign_id, 'low_utilization' FROM curves WHERE avg_daily_spend < 0.3 * (SELECT avg(avg_daily_spend) FROM curves))""")
def campaign_buckets(spark, d):
    return X.campaign_buckets(cut_lineage(curves(spark, d)))


@query("context_summary", ["top_ids", "n_saturated", "n_headroom", "n_low_utilization", "platforms"],
       ["total_p50", "total_p10", "total_p90", "revenue_wow_change_pct", "total_daily_spend", "current_roas",
        "google_revenue", "meta_spend"], digits=2,
       ctes=f"{RECENT_SQL}, {CURVES_SQL.split(V.FACTS_SQL + ', ', 1)[1]}", source="""(
    SELECT (SELECT string_agg(campaign_id, ',' ORDER BY r DESC, campaign_id) FROM
        (SELECT campaign_id, round(sum(p50), 3) AS r FROM recent GROUP BY campaign_id ORDER BY r DESC, campaign_id LIMIT 5)) AS top_ids,
      (SELECT count(*) FROM curves WHERE saturation_score >= 0.75) AS n_saturated,
      (SELECT count(*) FROM curves WHERE saturation_score < 0.4) AS n_headroom,
      (SELECT count(*) FROM curves WHERE avg_daily_spend < 0.3 * (SELECT avg(avg_daily_spend) FROM curves)) AS n_low_utilization,
      (SELECT string_agg(platform, ',' ORDER BY platform) FROM (SELECT DISTINCT platform FROM recent)) AS platforms,
      (SELECT sum(p50) FROM recent) AS total_p50, (SELECT sum(p10) FROM recent) AS total_p10,
      (SELECT sum(p90) FROM recent) AS total_p90,
      ((SELECT sum(p50) FROM recent) - (SELECT sum(p50) FROM prior)) / (SELECT sum(p50) FROM prior) * 100 AS revenue_wow_change_pct,
      (SELECT sum(avg_daily_spend) FROM curves) AS total_daily_spend,
      (SELECT sum(avg_daily_revenue) / sum(avg_daily_spend) FROM curves) AS current_roas,
      (SELECT sum(p50) FROM recent WHERE platform = 'google') AS google_revenue,
      (SELECT sum(avg_daily_spend) FROM curves WHERE platform = 'meta') AS meta_spend)""")
def context_summary(spark, d):
    rows = V.stored_facts(spark, d)
    summary = X.context_summary(cut_lineage(V.forecast(spark, d, rows)),
                                cut_lineage(P.response_curves(rows, refinements=0)))
    return summary.select(
        F.concat_ws(",", F.transform("top_campaigns", lambda t: t["campaign_id"])).alias("top_ids"),
        "n_saturated", "n_headroom", "n_low_utilization",
        F.concat_ws(",", F.map_keys("revenue_by_platform")).alias("platforms"),
        "total_p50", "total_p10", "total_p90", "revenue_wow_change_pct", "total_daily_spend", "current_roas",
        F.col("revenue_by_platform")["google"].alias("google_revenue"),
        F.col("spend_by_platform")["meta"].alias("meta_spend"))

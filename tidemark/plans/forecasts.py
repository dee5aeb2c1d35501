"""Backtest folds, metrics, the quantile baseline, forecast reports and insights."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.metrics import METRIC_NAMES
from tidemark.operators import folds as B
from tidemark.operators import insights as I
from tidemark.operators import quantiles as Q
from tidemark.operators import reports as R
from tidemark.operators import risks as K
from tidemark.operators.backtest import score_segments
from tidemark.operators.calendar import calendar_covering
from tidemark.operators.features import budget_features, join_calendar
from tidemark.plans import tables as V
from tidemark.plans.ingest import calendar_sql
from tidemark.plans.registry import query
from tidemark.session import cut_lineage

# ---- folds -----------------------------------------------------------------------------------------

_FOLD_COLUMNS = ["fold_id", "train_start", "train_end", "val_start", "val_end", "n_train", "n_val",
                 "train_days", "val_days"]


def folds_sql(min_train=180, val=30, step=30) -> str:
    return f"""bounds AS (SELECT min(date) AS lo, max(date) AS hi FROM facts),
slots AS (SELECT lo, hi, CAST(lo + {min_train} + i * {step} AS DATE) AS val_start
          FROM bounds, (SELECT CAST(unnest(generate_series(0, 400)) AS INTEGER) AS i)
          WHERE lo + {min_train} + i * {step} + {val - 1} <= hi),
sized AS (SELECT lo AS train_start, val_start - 1 AS train_end, val_start, val_start + {val - 1} AS val_end,
   (SELECT count(*) FROM facts WHERE attribution_mature AND date < val_start) AS n_train,
   (SELECT count(*) FROM facts WHERE date BETWEEN val_start AND val_start + {val - 1}) AS n_val FROM slots),
folds AS (SELECT row_number() OVER (ORDER BY val_start) - 1 AS fold_id, *,
   train_end - train_start + 1 AS train_days, val_end - val_start + 1 AS val_days
   FROM sized WHERE n_train > 0 AND n_val > 0)"""


FOLDS_SQL = f"{V.FACTS_SQL}, {folds_sql()}"


@query("rolling_origin_folds", _FOLD_COLUMNS, source="folds", ctes=FOLDS_SQL)
def rolling_origin_folds(spark, d):
    return B.rolling_origin_folds(V.facts(spark, d))


@query("fold_summary", ["n_folds", "first_val", "last_val", "n_val"], ["mean_train"], ctes=FOLDS_SQL, source="""(
    SELECT count(*) AS n_folds, min(val_start) AS first_val, max(val_end) AS last_val,
      CAST(sum(n_val) AS BIGINT) AS n_val, avg(n_train) AS mean_train FROM folds)""")
def fold_summary(spark, d):
    return B.rolling_origin_folds(V.facts(spark, d)).agg(
        F.count(F.lit(1)).alias("n_folds"), F.min("val_start").alias("first_val"),
        F.max("val_end").alias("last_val"), F.sum("n_val").alias("n_val"), F.avg("n_train").alias("mean_train"))


@query("fold_assign", ["fold_id", "platform", "n_rows"], ["revenue"], ctes=FOLDS_SQL, digits=2, source="""(
    SELECT fold_id, platform, count(*) AS n_rows, sum(revenue_attributed) AS revenue
    FROM facts JOIN folds ON date BETWEEN val_start AND val_end GROUP BY fold_id, platform)""")
def fold_assign(spark, d):
    rows = V.stored_facts(spark, d)
    return B.assign_validation_folds(rows, B.rolling_origin_folds(rows)).groupBy("fold_id", "platform").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("revenue_attributed").alias("revenue"))


@query("leakage_check", ["n_folds", "n_overlaps", "n_shared"], ctes=FOLDS_SQL, source="""(
    SELECT count(*) AS n_folds, count(*) FILTER (train_end >= val_start) AS n_overlaps,
      (SELECT count(*) FROM facts v JOIN folds f ON v.date BETWEEN f.val_start AND f.val_end
         WHERE EXISTS (SELECT 1 FROM facts t WHERE t.attribution_mature AND t.date < f.val_start
                       AND t.campaign_id = v.campaign_id AND t.date = v.date)) AS n_shared FROM folds)""")
def leakage_check(spark, d):
    """Bounds of every fold, and the rows that any fold would share between both sides."""
    rows = V.stored_facts(spark, d)
    folds = B.rolling_origin_folds(rows)
    shared = B.shared_rows(rows, B.assign_validation_folds(rows, folds), ["campaign_id", "date"])
    return folds.agg(F.count(F.lit(1)).alias("n_folds")).select(
        "n_folds", B.leakage_violations(folds).agg(F.count(F.lit(1))).scalar().alias("n_overlaps"),
        shared.agg(F.count(F.lit(1))).scalar().alias("n_shared"))


# ---- quantile baseline and metrics -----------------------------------------------------------------


@query("baseline_quantiles", ["platform", "weekday"], ["p10", "p50", "p90"], source="seasonal", ctes=V.FORECAST_SQL)
def baseline_quantiles(spark, d):
    return V.seasonal_quantiles(V.facts(spark, d))


@query("exact_quantiles_portfolio", ["label"], ["q01", "q25", "q75", "q99"], source="""(
    SELECT l_returnflag AS label, quantile_cont(l_extendedprice, 0.01) AS q01, quantile_cont(l_extendedprice, 0.25) AS q25,
      quantile_cont(l_extendedprice, 0.75) AS q75, quantile_cont(l_extendedprice, 0.99) AS q99
    FROM lineitem GROUP BY 1)""")
def exact_quantiles_portfolio(spark, d):
    """Three groups that hold everything: the case a per-group sort could not survive."""
    rows = V.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("label"), "l_extendedprice")
    return Q.exact_quantiles(rows, ["label"], "l_extendedprice", {"q01": 0.01, "q25": 0.25, "q75": 0.75, "q99": 0.99})


@query("quantile_repair", ["l_orderkey", "l_linenumber"], ["p10", "p50", "p90"], source="""(
    SELECT l_orderkey, l_linenumber, greatest(least(a, b), 0) AS p10, greatest(b, 0) AS p50, greatest(c, b, 0) AS p90
    FROM (SELECT *, l_quantity - 25 AS a, l_quantity * l_discount * 10 - 10 AS b, l_tax * 500 - 20 AS c FROM lineitem))""")
def quantile_repair(spark, d):
    return Q.repair_quantiles(V.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") - 25).alias("p10"),
        (F.col("l_quantity") * F.col("l_discount") * 10 - 10).alias("p50"),
        (F.col("l_tax") * 500 - 20).alias("p90")))


METRICS_SQL = f"""{FOLDS_SQL}, seasonal AS (
  SELECT fold_id AS fold, platform, weekday, quantile_cont(revenue_attributed, 0.1) AS p10,
         quantile_cont(revenue_attributed, 0.5) AS p50, quantile_cont(revenue_attributed, 0.9) AS p90
  FROM (SELECT *, isodow(date) - 1 AS weekday FROM facts WHERE attribution_mature) f JOIN folds ON f.date < val_start
  GROUP BY fold_id, platform, weekday
), scored AS (
  SELECT fold_id, revenue_attributed AS y, p10, p50, p90
  FROM facts f JOIN folds ON f.date BETWEEN val_start AND val_end
    JOIN seasonal s ON fold_id = fold AND f.platform = s.platform AND isodow(f.date) - 1 = s.weekday WHERE attribution_mature
), per_fold AS (
  SELECT fold_id, count(*) AS n_val_mature, avg(abs(y - p50)) AS mae_p50, sqrt(avg((y - p50) * (y - p50))) AS rmse_p50,
    avg(abs(y - p50) / (abs(y) + 1)) * 100 AS mape_p50,
    avg(abs(y - p50) / ((abs(y) + abs(p50)) / 2 + 1)) * 100 AS smape_p50,
    avg(CASE WHEN y >= p10 THEN 0.1 * (y - p10) ELSE 0.9 * (p10 - y) END) AS pinball_p10,
    avg(CASE WHEN y >= p50 THEN 0.5 * (y - p50) ELSE 0.5 * (p50 - y) END) AS pinball_p50,
    avg(CASE WHEN y >= p90 THEN 0.9 * (y - p90) ELSE 0.1 * (p90 - y) END) AS pinball_p90,
    avg(CASE WHEN y BETWEEN p10 AND p90 THEN 1.0 ELSE 0.0 END) AS coverage_80
  FROM scored GROUP BY fold_id)"""


def _baseline_metrics(spark, d):
    """Each fold's validation rows scored with quantiles of the rows before it only."""
    rows = V.stored_facts(spark, d).withColumn("weekday", F.weekday("date"))
    folds = cut_lineage(B.rolling_origin_folds(rows))
    return B.fold_metrics(score_segments(["platform", "weekday"])(rows, folds))


@query("metrics_by_fold", ["fold_id", "n_val_mature"], METRIC_NAMES, source="per_fold", ctes=METRICS_SQL)
def metrics_by_fold(spark, d):
    return _baseline_metrics(spark, d)


@query("metrics_summary", [], [f"{s}_{m}" for m in METRIC_NAMES for s in ("mean", "std")], ctes=METRICS_SQL,
       source="(SELECT " + ", ".join(f"avg({m}) AS mean_{m}, stddev_pop({m}) AS std_{m}" for m in METRIC_NAMES)
              + " FROM per_fold)")
def metrics_summary(spark, d):
    return B.metric_summary(_baseline_metrics(spark, d))


# ---- forecast reports -------------------------------------------------------------------------------


@query("forecast_table", ["date", "campaign_id", "campaign_name", "platform", "is_future"],
       ["revenue_attributed", "p10", "p50", "p90"], source="forecast", ctes=V.FORECAST_SQL)
def forecast_table(spark, d):
    return V.forecast(spark, d)


@query("fan_chart", ["date"], ["p10", "p50", "p90", "actual"], ctes=V.FORECAST_SQL, digits=3,
       source="(SELECT date, sum(p10) AS p10, sum(p50) AS p50, sum(p90) AS p90, sum(revenue_attributed) AS actual "
              "FROM forecast GROUP BY date)")
def fan_chart(spark, d):
    return R.fan_chart(V.forecast(spark, d))


@query("platform_contribution", ["date"], V.PLATFORMS, ctes=V.FORECAST_SQL, digits=3,
       source="(SELECT date, " + ", ".join(f"coalesce(sum(p50) FILTER (platform = '{p}'), 0) AS {p}" for p in V.PLATFORMS)
              + " FROM forecast GROUP BY date)")
def platform_contribution(spark, d):
    return R.platform_contribution(V.forecast(spark, d), V.PLATFORMS)


RECENT_SQL = f"""{V.FORECAST_SQL}, anchor AS (SELECT max(date) AS m FROM forecast),
recent AS (SELECT * FROM forecast WHERE date >= (SELECT m FROM anchor) - 6),
prior AS (SELECT * FROM forecast WHERE date BETWEEN (SELECT m FROM anchor) - 13 AND (SELECT m FROM anchor) - 7)"""


@query("forecast_kpis", [], ["p10", "p50", "p90", "interval_width_pct"], ctes=RECENT_SQL, digits=3,
       source="(SELECT sum(p10) AS p10, sum(p50) AS p50, sum(p90) AS p90, "
              "(sum(p90) - sum(p10)) / sum(p50) * 100 AS interval_width_pct FROM recent)")
def forecast_kpis(spark, d):
    return R.forecast_kpis(V.forecast(spark, d))


@query("leaderboard", ["campaign_id"], ["p50"], ctes=V.FORECAST_SQL, digits=3,
       source="(SELECT campaign_id, sum(p50) AS p50 FROM forecast GROUP BY campaign_id "
              "ORDER BY round(sum(p50), 3) DESC, campaign_id LIMIT 10)")
def leaderboard(spark, d):
    return R.leaderboard(V.forecast(spark, d))


@query("raw_forecast_order", ["date", "campaign_id"], ["p50"], ctes=V.FORECAST_SQL,
       source="forecast ORDER BY date DESC, campaign_id")
def raw_forecast_order(spark, d):
    return R.raw_forecast_order(V.forecast(spark, d))


@query("union_future", ["date", "campaign_id", "is_future"], ["revenue_attributed", "p50"], source="forecast",
       ctes=V.FORECAST_SQL)
def union_future(spark, d):
    fc = V.forecast(spark, d)
    return R.union_future(fc.filter("NOT is_future"), fc.filter("is_future").drop("revenue_attributed"))


# ---- insights -----------------------------------------------------------------------------------------

_INSIGHT_KEYS = ["type", "severity", "title", "explanation", "metric_name", "metric_unit", "campaign_id", "platform"]
_INSIGHT_DOUBLES = ["metric_value", "confidence"]


def _n0(x):
    return f"format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT))"


def _title(c):
    return f"upper(left({c}, 1)) || substr({c}, 2)"


TREND_SQL = f"""(SELECT 'revenue_trend' AS type, CASE WHEN c >= 0 THEN 'positive' ELSE 'warning' END AS severity,
  'Revenue trending ' || CASE WHEN c >= 0 THEN 'up ' ELSE 'down ' END || printf('%.1f', abs(c)) || '% week-over-week' AS title,
  'The last 7 days generated $' || {_n0('r')} || ' in P50 revenue, compared with $' || {_n0('p')} ||
    ' in the prior 7-day period — a change of ' || printf('%+.1f', c) || '%.' AS explanation,
  'wow_revenue_change_pct' AS metric_name, c AS metric_value, '%' AS metric_unit,
  CAST(NULL AS VARCHAR) AS campaign_id, CAST(NULL AS VARCHAR) AS platform, 0.9 AS confidence
  FROM (SELECT r, p, (r - p) / p * 100 AS c FROM (SELECT (SELECT sum(p50) FROM recent) AS r, (SELECT sum(p50) FROM prior) AS p))
  WHERE p > 0 AND abs(c) >= 5)"""
SHARE_SQL = f"""(SELECT 'platform_share' AS type, CASE WHEN abs(dl) < 10 THEN 'info' ELSE 'warning' END AS severity,
  {_title('platform')} || CASE WHEN dl > 0 THEN ' gaining' ELSE ' losing' END || ' share (' || printf('%+.1f', dl) || 'pp)' AS title,
  {_title('platform')} || ' now accounts for ' || printf('%.1f', rs) || '% of forecast revenue ($' || {_n0('r')} ||
    '), versus ' || printf('%.1f', ps) || '% ($' || {_n0('p')} || ') last period.' AS explanation,
  'platform_share_delta_pp' AS metric_name, dl AS metric_value, 'pp' AS metric_unit,
  CAST(NULL AS VARCHAR) AS campaign_id, platform, 0.85 AS confidence
  FROM (SELECT platform, r, p, r / rt * 100 AS rs, p / pt * 100 AS ps, r / rt * 100 - p / pt * 100 AS dl
    FROM (SELECT platform, sum(p50) AS r FROM recent GROUP BY platform)
    LEFT JOIN (SELECT platform, sum(p50) AS p0 FROM prior GROUP BY platform) USING (platform),
    LATERAL (SELECT coalesce(p0, 0) AS p), (SELECT sum(p50) AS rt FROM recent), (SELECT sum(p50) AS pt FROM prior)
    WHERE rt > 0 AND pt > 0) WHERE abs(dl) >= 3)"""
CONFIDENCE_SQL = f"""(SELECT 'forecast_confidence' AS type, 'warning' AS severity,
  'Forecast confidence interval is wide (' || printf('%.0f', w) || '%)' AS title,
  'The P10/P90 interval spans $' || {_n0('a')} || ' to $' || {_n0('c')} || ' around a P50 of $' || {_n0('b')} ||
    ' — a range of ' || printf('%.0f', w) || '% of P50. Interpret point forecasts with caution.' AS explanation,
  'forecast_width_pct' AS metric_name, w AS metric_value, '%' AS metric_unit,
  CAST(NULL AS VARCHAR) AS campaign_id, CAST(NULL AS VARCHAR) AS platform, 0.95 AS confidence
  FROM (SELECT a, b, c, (c - a) / b * 100 AS w FROM (SELECT sum(p10) AS a, sum(p50) AS b, sum(p90) AS c FROM recent))
  WHERE b > 0 AND w > 60)"""
TOP_SQL = f"""(SELECT 'top_campaign' AS type, 'info' AS severity,
  'Top contributor: ' || campaign_id || ' (' || printf('%.1f', s) || '% of revenue)' AS title,
  'Campaign ''' || campaign_id || ''' generated $' || {_n0('r')} || ' in P50 forecast revenue over the last 7 days, representing '
    || printf('%.1f', s) || '% of total.' AS explanation,
  'campaign_revenue_share_pct' AS metric_name, s AS metric_value, '%' AS metric_unit,
  CAST(campaign_id AS VARCHAR) AS campaign_id, CAST(NULL AS VARCHAR) AS platform, 0.9 AS confidence
  FROM (SELECT campaign_id, r, r / t * 100 AS s FROM (SELECT campaign_id, sum(p50) AS r FROM recent GROUP BY campaign_id),
        (SELECT sum(p50) AS t FROM recent) ORDER BY round(r, 3) DESC, campaign_id LIMIT 3))"""
SPEND_SQL = f"""(SELECT 'spend_momentum' AS type, 'info' AS severity,
  {_title('platform')} || ' spend ' || CASE WHEN c > 0 THEN 'accelerating (' ELSE 'decelerating (' END || printf('%+.1f', c) || '%)' AS title,
  {_title('platform')} || ' spend over the last 7 days was $' || {_n0('r')} || ', ' || printf('%+.1f', c) ||
    '% vs prior period ($' || {_n0('p')} || ').' AS explanation,
  'spend_change_pct' AS metric_name, c AS metric_value, '%' AS metric_unit,
  CAST(NULL AS VARCHAR) AS campaign_id, platform, 0.9 AS confidence
  FROM (SELECT platform, r, p, (r - p) / p * 100 AS c FROM (
    SELECT platform, sum(spend) FILTER (date >= m - 6) AS r, sum(spend) FILTER (date BETWEEN m - 13 AND m - 7) AS p
    FROM facts, (SELECT max(date) AS m FROM facts) GROUP BY platform)) WHERE r IS NOT NULL AND p > 0 AND abs(c) >= 10)"""
HOLIDAY_SQL = """(SELECT 'holiday_signal' AS type, 'positive' AS severity,
  'Elevated holiday intensity detected (score=' || printf('%.2f', s) || ')' AS title,
  'The average holiday intensity score over the last 7 days is ' || printf('%.2f', s) ||
    ' (scale 0–1), indicating seasonal demand uplift. Forecasts may underestimate peak revenue if not extrapolating this signal.'
    AS explanation,
  'holiday_intensity_score' AS metric_name, s AS metric_value, '' AS metric_unit,
  CAST(NULL AS VARCHAR) AS campaign_id, CAST(NULL AS VARCHAR) AS platform, 0.7 AS confidence
  FROM (SELECT avg(holiday_intensity_score) AS s FROM facts JOIN calendar USING (date)
        WHERE date >= (SELECT max(date) FROM facts) - 7) WHERE s > 0.3)"""
_HOLIDAY_CTES = f"{V.FACTS_SQL}, {calendar_sql('(SELECT DISTINCT date FROM facts)')}"


def with_holidays(rows):
    return join_calendar(rows, calendar_covering(rows))


def _insight(name, source, ctes, build):
    query(name, _INSIGHT_KEYS, _INSIGHT_DOUBLES, source=source, ctes=ctes)(build)


_insight("revenue_trend", TREND_SQL, RECENT_SQL, lambda s, d: I.revenue_trend(V.forecast(s, d)))
_insight("platform_share", SHARE_SQL, RECENT_SQL, lambda s, d: I.platform_share(cut_lineage(V.forecast(s, d))))
_insight("forecast_confidence", CONFIDENCE_SQL, RECENT_SQL, lambda s, d: I.forecast_confidence(V.forecast(s, d)))
_insight("top_campaign", TOP_SQL, RECENT_SQL, lambda s, d: I.top_campaign(cut_lineage(V.forecast(s, d))))
_insight("spend_momentum", SPEND_SQL, V.FACTS_SQL, lambda s, d: I.spend_momentum(V.facts(s, d)))
_insight("holiday_signal", HOLIDAY_SQL, _HOLIDAY_CTES, lambda s, d: I.holiday_signal(with_holidays(V.facts(s, d))))


def _all_insights(spark, d):
    rows = V.stored_facts(spark, d)
    return I.all_insights(cut_lineage(V.forecast(spark, d, rows)), with_holidays(rows))


_insight("all_insights", "(" + " UNION ALL ".join(
    f"SELECT * FROM {q}" for q in (TREND_SQL, SHARE_SQL, CONFIDENCE_SQL, TOP_SQL, SPEND_SQL, HOLIDAY_SQL)) + ")",
    f"{RECENT_SQL}, {calendar_sql('(SELECT DISTINCT date FROM facts)')}", _all_insights)

# ---- risks that need no curves ---------------------------------------------------------------------------

RISK_KEYS = ["type", "severity", "title", "explanation", "metric_name", "campaign_id", "platform", "recommendation"]
RISK_DOUBLES = ["metric_value", "threshold"]

UTILIZATION_SQL = f"""(SELECT 'budget_utilization' AS type, CASE WHEN u < 0.1 THEN 'critical' ELSE 'high' END AS severity,
  {_title('platform')} || ' · ' || campaign_id || ': budget utilisation ' || printf('%.0f', u * 100) || '%' AS title,
  'Campaign ''' || campaign_id || ''' (' || platform || ') spent only ' || printf('%.0f', u * 100) ||
    '% of its daily budget on average over the last 30 days. Threshold: 30%. Increasing budget further is unlikely to improve revenue.'
    AS explanation,
  'mean_budget_utilization' AS metric_name, u AS metric_value, 0.3 AS threshold,
  CAST(campaign_id AS VARCHAR) AS campaign_id, platform,
  CASE WHEN u < 0.1 THEN 'Budget for campaign ''' || campaign_id || ''' appears over-allocated. Reallocate surplus to campaigns with higher utilisation.'
  ELSE 'Review budget cap for campaign ''' || campaign_id || '''. Either the budget is too high or bids are too low to clear it.' END
    AS recommendation
  FROM (SELECT campaign_id, min(platform) AS platform, avg(spend / daily_budget) AS u FROM facts
        WHERE date >= (SELECT max(date) FROM facts) - 29 GROUP BY campaign_id) WHERE u <= 0.3)"""
ZERO_SQL = f"""(SELECT 'zero_revenue' AS type, 'high' AS severity,
  {_title('platform')} || ' · ' || campaign_id || ': ' || printf('%.0f', z * 100) || '% zero-revenue days' AS title,
  'Campaign ''' || campaign_id || ''' (' || platform || ') had ' || printf('%.0f', z * 100) ||
    '% of its spending days yield zero attributed revenue over the last 30 days. Attribution may be broken, or conversion tracking is missing.'
    AS explanation,
  'zero_revenue_fraction' AS metric_name, z * 100 AS metric_value, 30.0 AS threshold,
  CAST(campaign_id AS VARCHAR) AS campaign_id, platform,
  'Audit conversion tracking for this campaign. If tracking is correct, consider pausing or restructuring.' AS recommendation
  FROM (SELECT campaign_id, min(platform) AS platform, count(*) AS n,
          avg(CASE WHEN revenue_attributed = 0 THEN 1.0 ELSE 0.0 END) AS z FROM facts
        WHERE spend > 0 AND date >= (SELECT max(date) FROM facts) - 29 GROUP BY campaign_id) WHERE n >= 5 AND z >= 0.3)"""
CI_RISK_SQL = f"""(SELECT 'forecast_confidence' AS type, 'medium' AS severity,
  {_title('platform')} || ' · ' || campaign_id || ': low forecast confidence (' || printf('%.0f', w * 100) || '% CI width)' AS title,
  'Campaign ''' || campaign_id || ''' has a P10–P90 interval of $' || {_n0('a')} || '–$' || {_n0('c')} || ' around P50=$' || {_n0('b')} ||
    ' (width=' || printf('%.0f', w * 100) || '% of P50). Threshold: 60%. Decisions relying on this campaign''s forecast carry higher uncertainty.'
    AS explanation,
  'forecast_ci_width_pct' AS metric_name, w * 100 AS metric_value, 60.0 AS threshold,
  CAST(campaign_id AS VARCHAR) AS campaign_id, platform,
  'Avoid large budget commitments for this campaign until confidence improves.' AS recommendation
  FROM (SELECT campaign_id, platform, a, b, c, (c - a) / b AS w FROM (
    SELECT campaign_id, min(platform) AS platform, sum(p10) AS a, sum(p50) AS b, sum(p90) AS c FROM recent GROUP BY campaign_id)
    WHERE b > 0) WHERE w >= 0.6)"""


def _risk(name, source, ctes, build):
    query(name, RISK_KEYS, RISK_DOUBLES, source=source, ctes=ctes)(build)


_risk("budget_utilization_risk", UTILIZATION_SQL, V.FACTS_SQL,
      lambda s, d: K.budget_utilization_risk(budget_features(V.facts(s, d))))
_risk("zero_revenue_risk", ZERO_SQL, V.FACTS_SQL, lambda s, d: K.zero_revenue_risk(V.facts(s, d)))
_risk("confidence_risk", CI_RISK_SQL, RECENT_SQL, lambda s, d: K.confidence_risk(V.forecast(s, d)))

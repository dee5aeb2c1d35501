"""Feature-store queries: lags, trailing windows, momentum, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import features as O
from tidemark.operators import series as S
from tidemark.plans import tables as V
from tidemark.plans.ingest import FACT_KEYS, FACT_DOUBLES, calendar_sql, raw_exports
from tidemark.plans.registry import query
from tidemark.session import cut_lineage
from tidemark.operators.calendar import calendar_covering
from tidemark.operators.taxonomy import parse_taxonomy
from tidemark.roles import (
    BUDGET_COLUMNS, CALENDAR_PART_COLUMNS, HOLIDAY_COLUMNS, LAG_SPEC, MOMENTUM_SPEC, ROAS_LAGS,
    ROLLING_SPEC, TAXONOMY_COLUMNS, lag_columns, momentum_columns, roas_columns, rolling_columns, stem,
)

GRAIN = ["campaign_id", "date"]
_SQL_AGG = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
_W = "PARTITION BY campaign_id ORDER BY date"


def lag_sql(spec=None) -> str:
    return ", ".join(f"lag({c}, {n}) OVER ({_W}) AS {stem(c)}_lag_{n}"
                     for c, lags in (spec or LAG_SPEC).items() for n in lags)


def rolling_sql(spec=None, days: bool = False) -> str:
    def frame(k):
        return (f"RANGE BETWEEN INTERVAL {k} DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING" if days
                else f"ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING")

    return ", ".join(
        f"{_SQL_AGG[a]}({c}) OVER ({_W} {frame(k)}) AS {stem(c)}_roll_{a}_{k}"
        for c, aggs in (spec or ROLLING_SPEC).items() for a, windows in aggs.items() for k in windows)


def day_lag_sql(spec) -> str:
    return ", ".join(
        f"max({c}) OVER ({_W} RANGE BETWEEN INTERVAL {n} DAYS PRECEDING AND INTERVAL {n} DAYS PRECEDING) "
        f"AS {stem(c)}_lag_{n}" for c, lags in spec.items() for n in lags)


def momentum_sql(spec=None) -> str:
    return ", ".join(f"{p}_lag_1 / nullif({p}_roll_mean_{w}, 0) AS {p}_momentum_{w}"
                     for p, windows in (spec or MOMENTUM_SPEC).items() for w in windows)


WINDOWED_SQL = f"""{V.FACTS_SQL}, windowed AS (SELECT *, {lag_sql()}, {rolling_sql()} FROM facts),
moved AS (SELECT *, {momentum_sql()},
  {', '.join(f'revenue_lag_{w} / nullif(spend_lag_{w}, 0) AS roas_lag_{w}' for w in ROAS_LAGS)} FROM windowed)"""


@query("lag_features", GRAIN, lag_columns(), ctes=f"{V.FACTS_SQL}, lagged AS (SELECT *, {lag_sql()} FROM facts)",
       source="lagged")
def lag_features(spark, d):
    return O.lag_features(V.facts(spark, d))


_MEANS = {c: {"mean": a["mean"]} for c, a in ROLLING_SPEC.items()}
_STDS = {c: {"std": a["std"]} for c, a in ROLLING_SPEC.items() if "std" in a}
_EXTREMES = {c: {k: a[k] for k in ("min", "max")} for c, a in ROLLING_SPEC.items() if "min" in a}


def _register_rolling(name, spec):
    @query(name, GRAIN, rolling_columns(spec),
           ctes=f"{V.FACTS_SQL}, rolled AS (SELECT *, {rolling_sql(spec)} FROM facts)", source="rolled")
    def build(spark, d):
        return O.rolling_features(V.facts(spark, d), spec)


_register_rolling("rolling_mean", _MEANS)
_register_rolling("rolling_std", _STDS)
_register_rolling("rolling_minmax", _EXTREMES)

_LAG1 = {"revenue_attributed": (1,), "spend": (1,)}
_MOMENTUM_MEANS = {"revenue_attributed": {"mean": (7, 14, 28)}, "spend": {"mean": (7, 14, 28)}}


@query("momentum", GRAIN, momentum_columns(), source="moved", ctes=f"""{V.FACTS_SQL}, windowed AS (
  SELECT *, {lag_sql(_LAG1)}, {rolling_sql(_MOMENTUM_MEANS)} FROM facts),
  moved AS (SELECT *, {momentum_sql()} FROM windowed)""")
def momentum(spark, d):
    return O.momentum(O.rolling_features(O.lag_features(V.facts(spark, d), _LAG1), _MOMENTUM_MEANS))


@query("roas_lags", GRAIN, roas_columns(), source="moved", ctes=WINDOWED_SQL)
def roas_lags(spark, d):
    spec = {"revenue_attributed": ROAS_LAGS, "spend": ROAS_LAGS}
    return O.roas_lags(O.lag_features(V.facts(spark, d), spec))


_DAY_LAGS = {"revenue_attributed": (1, 3, 7, 14, 28)}
_DAY_ROLLS = {"revenue_attributed": ROLLING_SPEC["revenue_attributed"]}
_DAY_COLUMNS = lag_columns(_DAY_LAGS) + rolling_columns(_DAY_ROLLS)


def _by_days(df):
    return O.rolling_features(O.lag_features(df, _DAY_LAGS, mode="days"), _DAY_ROLLS, mode="days")


@query("range_lag_rolling", GRAIN, _DAY_COLUMNS, source="ranged",
       ctes=f"{V.FACTS_SQL}, ranged AS (SELECT *, {day_lag_sql(_DAY_LAGS)}, {rolling_sql(_DAY_ROLLS, True)} FROM facts)")
def range_lag_rolling(spark, d):
    return _by_days(V.facts(spark, d))


@query("range_lag_rolling_events", GRAIN, _DAY_COLUMNS, source="ranged",
       ctes=f"{V.EVENT_DAYS_SQL}, ranged AS (SELECT *, {day_lag_sql(_DAY_LAGS)}, {rolling_sql(_DAY_ROLLS, True)} "
            "FROM event_days)")
def range_lag_rolling_events(spark, d):
    return _by_days(V.event_days(spark, d))


@query("budget_features", GRAIN, BUDGET_COLUMNS, ctes=V.FACTS_SQL,
       source="(SELECT campaign_id, date, spend / nullif(daily_budget, 0) AS budget_utilization, "
              "daily_budget - spend AS budget_headroom FROM facts)")
def budget_features(spark, d):
    return O.budget_features(V.facts(spark, d))


# The campaign dimension of the facts, spelled from the same name parts by another route.
FACT_TAXONOMY_SQL = """dim AS (
  SELECT platform, campaign_id,
    CASE WHEN platform <> 'meta' THEN regexp_extract(campaign_name, '^(.*?)(_TM|_NTM)?_Campaign_', 1) END AS format,
    CASE WHEN platform <> 'meta' THEN nullif(regexp_extract(campaign_name, '_(TM|NTM)_Campaign_', 1), '') END
      AS audience_strategy,
    CASE WHEN platform = 'meta' THEN regexp_extract(campaign_name, '^(Prospecting|Remarketing|Generic)', 1) END
      AS funnel_stage,
    CASE WHEN platform = 'meta' THEN nullif(regexp_extract(campaign_name, '_(Brand|DPA|Adv_Plus)_Campaign_', 1), '') END
      AS ad_product_type,
    platform || '_' || replace(replace(regexp_extract(campaign_name, '^(.*)_Campaign_', 1), ' ', '_'), '__', '_')
      AS strategy_key,
    contains(campaign_name, '_TM_') OR contains(campaign_name, '_Brand_') AS is_brand,
    contains(campaign_name, '_NTM_') OR contains(campaign_name, '_DPA_') OR contains(campaign_name, '_Adv_Plus_')
      AS is_non_brand,
    channel_format = 'UpperFunnel' AS is_upper_funnel, false AS cross_engine_pair_flag
  FROM campaigns
)"""


@query("join_taxonomy", [*FACT_KEYS, *TAXONOMY_COLUMNS], source="facts JOIN dim USING (platform, campaign_id)",
       ctes=f"{V.FACTS_SQL}, {FACT_TAXONOMY_SQL}")
def join_taxonomy(spark, d):
    rows = V.stored_facts(spark, d)
    return O.join_taxonomy(rows, parse_taxonomy(rows))


_EVENT_CALENDAR = calendar_sql(
    "(SELECT DISTINCT date FROM event_days)")


@query("join_calendar", [*GRAIN, *[c for c in HOLIDAY_COLUMNS if c != "holiday_intensity_score"]],
       ["revenue_attributed", "holiday_intensity_score"], source="event_days JOIN calendar USING (date)",
       ctes=f"{V.EVENT_DAYS_SQL}, {_EVENT_CALENDAR}")
def join_calendar(spark, d):
    rows = V.event_days(spark, d)
    return O.join_calendar(rows, calendar_covering(rows))


STORE_SQL = f"""{WINDOWED_SQL}, {FACT_TAXONOMY_SQL}, {calendar_sql('(SELECT DISTINCT date FROM facts)')}, store AS (
  SELECT * EXCLUDE (holiday_name), isodow(date) - 1 AS day_of_week, day(date) AS day_of_month,
    weekofyear(date) AS week_of_year, month(date) AS month, quarter(date) AS quarter, year(date) AS year,
    isodow(date) >= 6 AS is_weekend, spend / nullif(daily_budget, 0) AS budget_utilization,
    daily_budget - spend AS budget_headroom
  FROM moved JOIN dim USING (platform, campaign_id) JOIN calendar USING (date)
)"""
STORE_KEYS = [*FACT_KEYS, *TAXONOMY_COLUMNS, *CALENDAR_PART_COLUMNS,
              *[c for c in HOLIDAY_COLUMNS if c != "holiday_intensity_score"]]
STORE_DOUBLES = [*FACT_DOUBLES, *lag_columns(), *rolling_columns(), *momentum_columns(), *BUDGET_COLUMNS,
                 *roas_columns(), "holiday_intensity_score"]


def feature_table(spark, d, rows=None, keep=None):
    """Feature store with dimensions from their own tables, so that the facts are read once."""
    days = V.table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"))
    rows = V.facts(spark, d) if rows is None else rows
    return O.build_feature_store(rows, parse_taxonomy(V.campaigns(spark, d)), calendar_covering(days), keep=keep)


@query("feature_store", STORE_KEYS, STORE_DOUBLES, source="store", ctes=STORE_SQL)
def feature_store(spark, d):
    return feature_table(spark, d)


@query("feature_store_from_exports", ["platform", "n_rows", "n_days"],
       ["revenue_roll_mean_7", "roas_lag_7", "holiday_intensity_score"], ctes=STORE_SQL, digits=3,
       source="""(SELECT platform, count(*) AS n_rows, count(DISTINCT date) AS n_days,
         avg(revenue_roll_mean_7) AS revenue_roll_mean_7, avg(roas_lag_7) AS roas_lag_7,
         avg(holiday_intensity_score) AS holiday_intensity_score FROM store GROUP BY platform)""")
def feature_store_from_exports(spark, d):
    """The whole path: three exports, harmonized, to a summary of the feature store."""
    from tidemark.operators.harmonize import harmonize

    store = O.build_feature_store(cut_lineage(harmonize(*raw_exports(spark, d), check=False)))
    return store.groupBy("platform").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.col("date")).alias("n_days"),
        *[F.avg(c).alias(c) for c in ("revenue_roll_mean_7", "roas_lag_7", "holiday_intensity_score")])


# ---- recent rows -------------------------------------------------------------------------------------


@query("trailing_rows", GRAIN, ["spend", "revenue_attributed"], ctes=V.FACTS_SQL, source="""(
    SELECT * FROM facts WHERE attribution_mature
    QUALIFY row_number() OVER (PARTITION BY campaign_id ORDER BY date DESC) <= 30)""")
def trailing_rows(spark, d):
    return S.trailing_rows(S.mature_rows(V.facts(spark, d)))


@query("latest_rows", ["platform", "campaign_id", "campaign_name", "date"], ["spend", "revenue_attributed"],
       ctes=V.FACTS_SQL, source="""(
    SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY campaign_id ORDER BY date DESC) = 1)""")
def latest_rows(spark, d):
    return S.latest_rows(V.facts(spark, d))


@query("trailing_and_prior_days", ["period", *GRAIN], ["spend"], ctes=V.FACTS_SQL, source="""(
    SELECT 'recent' AS period, campaign_id, date, spend FROM facts
      WHERE date >= (SELECT max(date) FROM facts) - 29
    UNION ALL SELECT 'prior', campaign_id, date, spend FROM facts
      WHERE date BETWEEN (SELECT max(date) FROM facts) - 59 AND (SELECT max(date) FROM facts) - 30)""")
def trailing_and_prior_days(spark, d):
    rows = V.stored_facts(spark, d)
    return S.trailing_days(rows, 30).withColumn("period", F.lit("recent")).unionByName(
        S.prior_days(rows, 30).withColumn("period", F.lit("prior")))


@query("period_over_period", ["platform", "n_recent", "n_prior"], ["recent", "prior", "change_pct"], digits=3,
       ctes=V.FACTS_SQL, source="""(
    SELECT platform, count(*) FILTER (r) AS n_recent, count(*) FILTER (p) AS n_prior,
      coalesce(sum(spend) FILTER (r), 0) AS recent, coalesce(sum(spend) FILTER (p), 0) AS prior,
      (sum(spend) FILTER (r) - sum(spend) FILTER (p)) / nullif(sum(spend) FILTER (p), 0) * 100 AS change_pct
    FROM (SELECT *, date >= m - 6 AS r, date BETWEEN m - 13 AND m - 7 AS p
          FROM facts, (SELECT max(date) AS m FROM facts)) WHERE r OR p GROUP BY platform)""")
def period_over_period(spark, d):
    return S.period_over_period(V.facts(spark, d), "spend", 7, ["platform"])


@query("campaign_filter", ["platform", *GRAIN], ["spend"], ctes=V.FACTS_SQL,
       source="(SELECT * FROM facts WHERE platform IN ('google', 'bing'))")
def campaign_filter(spark, d):
    """Dashboard selection by platform."""
    return S.select_campaigns(V.facts(spark, d), ["google", "bing"])

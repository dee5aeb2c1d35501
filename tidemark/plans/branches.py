"""Views of the same tables in which the rarer branches of insights, risks and reports are taken.

Each view changes whole columns of whole tables, on both sides alike; the operators and their SQL
twins stay those of the plain queries.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import context as X
from tidemark.operators import insights as I
from tidemark.operators import reports as R
from tidemark.operators import response as H
from tidemark.operators import risks as K
from tidemark.operators.features import budget_features
from tidemark.plans import forecasts as P
from tidemark.plans import response as C
from tidemark.plans import tables as V
from tidemark.plans.ingest import calendar_sql
from tidemark.plans.registry import query
from tidemark.session import cut_lineage

# ---- forecasts whose last week differs -----------------------------------------------------------------


def _last_week(spark, d, factor):
    """The forecast with the P50 of its last seven days scaled."""
    fc = cut_lineage(V.forecast(spark, d))
    first = fc.agg(F.date_sub(F.max("date"), 6)).scalar()
    return fc.withColumn("p50", F.when(F.col("date") >= first, F.col("p50") * factor).otherwise(F.col("p50")))


for _name, _factor in (("revenue_trend_up", 1.5), ("revenue_trend_down", 0.5)):
    query(_name, P._INSIGHT_KEYS, P._INSIGHT_DOUBLES, ctes=P.RECENT_SQL,
          source=P.TREND_SQL.replace("sum(p50) FROM recent", f"sum(p50 * {_factor}) FROM recent"))(
        lambda s, d, factor=_factor: I.revenue_trend(_last_week(s, d, factor)))

# ---- facts that end on the last of November, or spend a tenth -------------------------------------------------

_NOVEMBER = (f"{V.FACTS_SQL}, dated AS (SELECT * REPLACE (CAST(date + CAST(DATE '2024-11-30' - (SELECT max(date) FROM facts) "
             f"AS INTEGER) AS DATE) AS date) FROM facts), {calendar_sql('(SELECT DISTINCT date FROM dated)')}")


@query("holiday_signal_november", P._INSIGHT_KEYS, P._INSIGHT_DOUBLES, ctes=_NOVEMBER, source=P.HOLIDAY_SQL.replace("facts", "dated"))
def holiday_signal_november(spark, d):
    rows = V.stored_facts(spark, d)
    shift = F.datediff(F.lit("2024-11-30").cast("date"), rows.agg(F.max("date")).scalar())
    dated = cut_lineage(rows.withColumn("date", F.date_add("date", shift)))
    return I.holiday_signal(P.with_holidays(dated))


@query("budget_utilization_low", P.RISK_KEYS, P.RISK_DOUBLES, source=P.UTILIZATION_SQL.replace("FROM facts", "FROM thrifty"),
       ctes=f"{V.FACTS_SQL}, thrifty AS (SELECT * REPLACE (spend / 10 AS spend) FROM facts)")
def budget_utilization_low(spark, d):
    rows = V.stored_facts(spark, d).withColumn("spend", F.col("spend") / 10)
    return K.budget_utilization_risk(budget_features(rows))


# ---- curves closer to saturation, and one dominant platform -----------------------------------------------------

_STEEP = f"""{C.CURVES_SQL}, steep AS (SELECT * REPLACE (least(saturation_score * 1.5, 1) AS saturation_score,
  avg_daily_spend * CASE WHEN platform = 'google' THEN 9 ELSE 1 END AS avg_daily_spend) FROM curves)"""


def _steep(spark, d):
    google = F.when(F.col("platform") == "google", 9).otherwise(1)
    return cut_lineage(C.curves(spark, d).withColumns({
        "saturation_score": F.least(F.col("saturation_score") * 1.5, F.lit(1.0)),
        "avg_daily_spend": F.col("avg_daily_spend") * google}))


@query("saturation_risk_steep", C.RISK_KEYS, C.RISK_DOUBLES, ctes=_STEEP, source=C.SATURATION_SQL.replace("FROM curves", "FROM steep"))
def saturation_risk_steep(spark, d):
    return K.saturation_risk(_steep(spark, d))


@query("concentration_risk_steep", C.RISK_KEYS, C.RISK_DOUBLES, ctes=_STEEP, source=C.CONCENTRATION_SQL.replace("FROM curves", "FROM steep"))
def concentration_risk_steep(spark, d):
    return K.concentration_risk(_steep(spark, d))


@query("campaign_buckets_steep", ["campaign_id", "bucket"], ctes=_STEEP, source="""(
    SELECT campaign_id, 'saturated' AS bucket FROM steep WHERE saturation_score >= 0.75
    UNION ALL SELECT campaign_id, 'has_headroom' FROM steep WHERE saturation_score < 0.4
    UNION ALL SELECT campaign_id, 'low_utilization' FROM steep WHERE avg_daily_spend < 0.3 * (SELECT avg(avg_daily_spend) FROM steep))""")
def campaign_buckets_steep(spark, d):
    return X.campaign_buckets(_steep(spark, d))


@query("portfolio_kpis_steep", ["n_campaigns", "n_saturated", "n_headroom"], ctes=_STEEP, source="""(
    SELECT count(*) AS n_campaigns, count(*) FILTER (saturation_score >= 0.75) AS n_saturated,
      count(*) FILTER (saturation_score < 0.4) AS n_headroom FROM steep)""")
def portfolio_kpis_steep(spark, d):
    return R.portfolio_kpis(_steep(spark, d))


# ---- spends that no curve can be fitted to -----------------------------------------------------------------------

_FLAT = """CASE campaign_id % 3 WHEN 0 THEN CASE WHEN spend > 0 THEN 100.0 ELSE 0.0 END
  WHEN 1 THEN CASE WHEN month(date) = 1 AND day(date) = 1 THEN spend ELSE 0.0 END ELSE spend END"""


@query("fit_hill_flat", C._FIT_KEYS, ["slope", "k", "n", "r_squared"], source="(SELECT *, v_max / k AS slope FROM fit)",
       ctes=f"{V.FACTS_SQL}, flat AS (SELECT * REPLACE ({_FLAT} AS spend) FROM facts), {C.HILL_SQL.replace('FROM facts', 'FROM flat')}")
def fit_hill_flat(spark, d):
    """A third of the campaigns spends the same every day, a third on New Year only: both fall back to a line."""
    fit = H.fit_hill(V.stored_facts(spark, d).withColumn("spend", F.expr(_FLAT)), refinements=0)
    return fit.withColumn("slope", F.col("v_max") / F.col("k"))

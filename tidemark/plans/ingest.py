"""Sources, harmonization, quality, taxonomy and calendar over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions.names import meta_channel as meta_channel_of
from tidemark.operators import harmonize as H
from tidemark.operators import quality as Q
from tidemark.operators import taxonomy as X
from tidemark.operators.calendar import CALENDAR_COLUMNS, calendar_covering
from tidemark.plans import tables as V
from tidemark.plans.registry import query
from tidemark.roles import CANONICAL_SCHEMA
from tidemark.session import cut_lineage
from tidemark.sources.platforms import profile

FACT_KEYS = ["platform", "campaign_id", "campaign_name", "date", "channel_format", "attribution_mature"]
FACT_DOUBLES = [c for c, t in CANONICAL_SCHEMA.items() if t == "double"]

# ---- sources -------------------------------------------------------------------------------


def _profile_sql(label, table, date, entity, columns):
    nulls = " + ".join(f"count(*) - count({c})" for c in columns)
    names = ", ".join(f"CASE WHEN count({c}) < count(*) THEN '{c}' END" for c in columns)
    return (f"SELECT '{label}' AS source, count(*) AS n_rows, CAST({len(columns)} AS BIGINT) AS n_columns, "
            f"CAST(min({date}) AS DATE) AS min_date, CAST(max({date}) AS DATE) AS max_date, "
            f"count(DISTINCT {entity}) AS n_campaigns, CAST({nulls} AS BIGINT) AS n_null_cells, "
            f"concat_ws(',', {names}) AS null_columns FROM {table}")


_SUPPLIER_BUDGET = "(SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS budget, DATE '2024-01-01' AS day FROM supplier)"


@query(
    "source_profile",
    ["source", "n_rows", "n_columns", "min_date", "max_date", "n_campaigns", "n_null_cells", "null_columns"],
    source="(" + " UNION ALL ".join([
        _profile_sql("lines", "lineitem", "l_shipdate", "l_suppkey",
                     ["l_suppkey", "l_orderkey", "l_quantity", "l_shipdate"]),
        _profile_sql("events", "events", "ts", "event_type", ["ts", "event_type", "value"]),
        _profile_sql("budgets", _SUPPLIER_BUDGET, "day", "s_suppkey", ["s_suppkey", "budget", "day"]),
    ]) + ")",
)
def source_profile(spark, d):
    budgets = V.table(spark, d, "supplier").select(
        "s_suppkey", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("budget"),
        F.lit("2024-01-01").cast("date").alias("day"))
    return profile({
        "lines": (V.table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_quantity", "l_shipdate"),
                  "l_shipdate", "l_suppkey"),
        "events": (V.table(spark, d, "events").select("ts", "event_type", "value"), "ts", "event_type"),
        "budgets": (budgets, "day", "s_suppkey"),
    })


# ---- harmonization -----------------------------------------------------------------------------


def raw_exports(spark, d):
    """The supplied tables in the shape of the three platform exports."""
    rows = cut_lineage(V.daily_lines(spark, d).join(V.campaigns(spark, d), "campaign_id"))
    google_type = F.expr("CASE channel_format WHEN 'PMax' THEN 'PERFORMANCE_MAX' WHEN 'Search' THEN 'SEARCH' "
                         "WHEN 'UpperFunnel' THEN 'DEMAND_GEN' ELSE 'SHOPPING' END")
    bing_type = F.expr("CASE channel_format WHEN 'PMax' THEN 'PerformanceMax' WHEN 'Search' THEN 'Search' "
                       "WHEN 'UpperFunnel' THEN 'Audience' ELSE 'Shopping' END")
    google = rows.filter("platform = 'google'").select(
        "campaign_id", F.col("date").alias("segments_date"),
        F.col("clicks").cast("bigint").alias("metrics_clicks"),
        F.col("conversions").alias("metrics_conversions"),
        F.round(F.col("spend") * 1e6).cast("bigint").alias("metrics_cost_micros"),
        F.col("impressions").cast("bigint").alias("metrics_impressions"),
        (F.col("clicks") * 3).cast("bigint").alias("metrics_video_views"),
        F.col("revenue_attributed").alias("metrics_conversions_value"),
        google_type.alias("campaign_advertising_channel_type"),
        F.col("daily_budget").alias("campaign_budget_amount"), "campaign_name",
    )
    meta = rows.filter("platform = 'meta'").select(
        "campaign_id", F.col("date").alias("date_start"), (F.col("clicks") * 2).alias("reach"), "spend", "clicks",
        "impressions", F.col("revenue_attributed").alias("conversion"), "daily_budget", "campaign_name",
    )
    bing = rows.filter("platform = 'bing'").select(
        F.col("campaign_id").alias("CampaignId"), F.col("date").alias("TimePeriod"),
        F.col("revenue_attributed").alias("Revenue"), F.col("spend").alias("Spend"),
        F.col("clicks").cast("bigint").alias("Clicks"), F.col("impressions").cast("bigint").alias("Impressions"),
        F.col("conversions").alias("Conversions"), bing_type.alias("CampaignType"),
        F.col("daily_budget").alias("DailyBudget"), F.col("campaign_name").alias("CampaignName"),
    )
    return google, meta, bing


@query("harmonize_union", FACT_KEYS, FACT_DOUBLES, source="facts", ctes=V.FACTS_SQL)
def harmonize_union(spark, d):
    return H.harmonize(*raw_exports(spark, d), check=False)


_TYPES = ["SEARCH", "PERFORMANCE_MAX", "SHOPPING", "VIDEO", "DEMAND_GEN", "DISPLAY", "HOTEL"]
_BING_TYPES = ["Search", "PerformanceMax", "Shopping", "Audience", "search"]
_TYPE_SQL = "CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TYPES)) + " END"
_BING_TYPE_SQL = "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_BING_TYPES)) + " END"


@query(
    "channel_map", ["p_partkey", "google_channel", "bing_channel"],
    source=f"""(SELECT p_partkey,
      CASE {_TYPE_SQL} WHEN 'SEARCH' THEN 'Search' WHEN 'PERFORMANCE_MAX' THEN 'PMax' WHEN 'SHOPPING' THEN 'Shopping'
        WHEN 'VIDEO' THEN 'UpperFunnel' WHEN 'DEMAND_GEN' THEN 'UpperFunnel' WHEN 'DISPLAY' THEN 'UpperFunnel'
        ELSE 'Other' END AS google_channel,
      CASE {_BING_TYPE_SQL} WHEN 'Search' THEN 'Search' WHEN 'PerformanceMax' THEN 'PMax' WHEN 'Shopping' THEN 'Shopping'
        WHEN 'Audience' THEN 'UpperFunnel' ELSE 'Other' END AS bing_channel
      FROM part)""",
)
def channel_map(spark, d):
    return V.table(spark, d, "part").select(
        "p_partkey", H.google_channel(F.expr(_TYPE_SQL)).alias("google_channel"),
        H.bing_channel(F.expr(_BING_TYPE_SQL)).alias("bing_channel"))


_META_SQL = """CASE WHEN contains(campaign_name, 'Adv_Plus') THEN 'PMax' WHEN contains(campaign_name, 'DPA') THEN 'Shopping'
  WHEN contains(campaign_name, 'Brand') THEN 'Brand' WHEN contains(campaign_name, 'Remarketing') THEN 'Remarketing'
  WHEN contains(campaign_name, 'Prospecting') THEN 'Prospecting' ELSE 'Other' END"""


@query("meta_channel", ["campaign_id", "campaign_name", "channel"], ctes=V.NAMES_SQL,
       source=f"(SELECT campaign_id, campaign_name, {_META_SQL} AS channel FROM names)")
def meta_channel(spark, d):
    return V.part_names(spark, d).withColumn("channel", meta_channel_of("campaign_name"))


@query("attribution_maturity", ["platform", "campaign_id", "date", "attribution_mature"],
       source="facts", ctes=V.FACTS_SQL)
def attribution_maturity(spark, d):
    return V.facts(spark, d)


@query("mature_counts", ["platform", "n_rows", "n_mature"], ctes=V.FACTS_SQL,
       source="(SELECT platform, count(*) AS n_rows, count(*) FILTER (attribution_mature) AS n_mature "
              "FROM facts GROUP BY platform)")
def mature_counts(spark, d):
    return V.facts(spark, d).groupBy("platform").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("attribution_mature").alias("n_mature"))


# ---- quality -------------------------------------------------------------------------------------

_DIRTY_SQL = """dirty AS (
  SELECT l_returnflag AS platform, l_suppkey AS campaign_id, CAST(l_shipdate AS DATE) AS date,
         l_extendedprice * (l_tax - 0.02) AS spend, l_extendedprice * (0.08 - l_discount) AS revenue_attributed
  FROM lineitem
)"""


def dirty_lines(spark, d):
    """Unaggregated lines with negative values: something for the checks to find."""
    return V.table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("platform"), F.col("l_suppkey").alias("campaign_id"),
        F.col("l_shipdate").cast("date").alias("date"),
        (F.col("l_extendedprice") * (F.col("l_tax") - 0.02)).alias("spend"),
        (F.col("l_extendedprice") * (0.08 - F.col("l_discount"))).alias("revenue_attributed"))


@query("dq_violations", ["check_name", "n_rows"], ctes=_DIRTY_SQL, source="""(
    SELECT 'negative_spend' AS check_name, count(*) FILTER (spend < 0) AS n_rows FROM dirty
    UNION ALL SELECT 'negative_revenue', count(*) FILTER (revenue_attributed < 0) FROM dirty
    UNION ALL SELECT 'duplicate_key', CAST(coalesce(sum(n), 0) AS BIGINT)
      FROM (SELECT count(*) AS n FROM dirty GROUP BY platform, campaign_id, date HAVING count(*) > 1))""")
def dq_violations(spark, d):
    return Q.fact_violations(dirty_lines(spark, d))


@query("duplicate_keys", ["campaign_id", "date", "n_rows"], ctes=_DIRTY_SQL, source="""(
    SELECT campaign_id, date, count(*) AS n_rows FROM dirty GROUP BY campaign_id, date HAVING count(*) > 1)""")
def duplicate_keys(spark, d):
    return Q.duplicate_keys(dirty_lines(spark, d), ["campaign_id", "date"])


@query("dimension_violations", ["check_name", "platform", "n_rows"], ctes=V.NAMES_SQL, source="""(
    SELECT 'duplicate_id' AS check_name, platform, count(*) - count(DISTINCT campaign_id) AS n_rows
      FROM names GROUP BY platform
    UNION ALL SELECT 'duplicate_name', platform, count(*) - count(DISTINCT campaign_name) FROM names GROUP BY platform)""")
def dimension_violations(spark, d):
    return Q.dimension_violations(V.part_names(spark, d))


@query("input_violations", ["check_name", "n_rows"], source="""(
    SELECT 'empty_input' AS check_name, CAST(count(*) = 0 AS BIGINT) AS n_rows FROM lineitem
    UNION ALL SELECT 'null_date', count(*) FILTER (l_shipdate IS NULL) FROM lineitem
    UNION ALL SELECT 'null_entity', count(*) FILTER (CASE WHEN l_tax > 0 THEN l_suppkey END IS NULL) FROM lineitem)""")
def input_violations(spark, d):
    rows = V.table(spark, d, "lineitem").select(
        F.when(F.col("l_tax") > 0, F.col("l_suppkey")).alias("campaign_id"),
        F.col("l_shipdate").cast("date").alias("date"), F.col("l_quantity").alias("clicks"))
    return Q.input_violations(rows, ["clicks"])


@query("unmatched_dimension", ["check_name", "n_rows"], ctes=V.FACTS_SQL, source="""(
    SELECT 'no_budgeted_campaign' AS check_name, count(*) AS n_rows FROM facts f
    WHERE NOT EXISTS (SELECT 1 FROM campaigns c WHERE c.platform = f.platform AND c.campaign_id = f.campaign_id
                      AND c.daily_budget IS NOT NULL))""")
def unmatched_dimension(spark, d):
    dim = V.campaigns(spark, d).filter("daily_budget IS NOT NULL")
    return Q.unmatched(V.facts(spark, d), dim, ["platform", "campaign_id"], "no_budgeted_campaign")


@query("forecast_check",
       ["n_rows", "n_campaigns", "min_date", "max_date", "n_future", "n_history", "n_crossings", "n_negative_p50"],
       ctes=V.FORECAST_SQL, source="""(
    SELECT count(*) AS n_rows, count(DISTINCT campaign_id) AS n_campaigns, min(date) AS min_date, max(date) AS max_date,
           count(*) FILTER (is_future) AS n_future, count(*) FILTER (NOT is_future) AS n_history,
           count(*) FILTER (p10 > p50 OR p50 > p90) AS n_crossings, count(*) FILTER (p50 < 0) AS n_negative_p50
    FROM forecast)""")
def forecast_check(spark, d):
    return Q.forecast_violations(V.forecast(spark, d))


# ---- taxonomy --------------------------------------------------------------------------------------

_SPLIT_SQL = """split AS (
  SELECT *, contains(campaign_name, '_Campaign_') AS has_token,
         split_part(campaign_name, '_Campaign_', 1) AS head,
         substr(campaign_name, strpos(campaign_name, '_Campaign_') + 10) AS tail
  FROM names
), parsed AS (
  SELECT platform, campaign_id, campaign_name, channel_format,
    CASE WHEN has_token AND regexp_matches(tail, '^[+-]?[0-9]+$') THEN CAST(tail AS INTEGER) END AS campaign_number,
    CASE WHEN platform <> 'meta' THEN
      CASE WHEN NOT has_token THEN campaign_name
           WHEN suffix(head, '_NTM') THEN nullif(left(head, length(head) - 4), '')
           WHEN suffix(head, '_TM') THEN nullif(left(head, length(head) - 3), '')
           ELSE nullif(head, '') END END AS format,
    CASE WHEN platform <> 'meta' AND has_token THEN
      CASE WHEN suffix(head, '_NTM') THEN 'NTM' WHEN suffix(head, '_TM') THEN 'TM' END END AS audience_strategy,
    CASE WHEN platform = 'meta' AND has_token THEN
      CASE WHEN head = 'Prospecting' OR prefix(head, 'Prospecting_') THEN 'Prospecting'
           WHEN head = 'Remarketing' OR prefix(head, 'Remarketing_') THEN 'Remarketing'
           WHEN head = 'Generic' OR prefix(head, 'Generic_') THEN 'Generic' END END AS funnel_stage,
    CASE WHEN platform = 'meta' AND has_token THEN
      CASE WHEN prefix(head, 'Prospecting_') OR prefix(head, 'Remarketing_') THEN nullif(substr(head, 13), '')
           WHEN prefix(head, 'Generic_') THEN nullif(substr(head, 9), '') END END AS ad_product_type
  FROM split
), keyed AS (
  SELECT *, concat_ws('_', platform, replace(coalesce(format, funnel_stage), ' ', '_'),
                      replace(coalesce(audience_strategy, ad_product_type), ' ', '_')) AS strategy_key,
    coalesce(audience_strategy = 'TM', false) OR coalesce(ad_product_type = 'Brand', false) AS is_brand,
    coalesce(audience_strategy = 'NTM', false) OR coalesce(ad_product_type IN ('DPA', 'Adv_Plus'), false) AS is_non_brand,
    channel_format = 'UpperFunnel' AS is_upper_funnel,
    campaign_name IN (SELECT campaign_name FROM names WHERE platform = 'google'
                      INTERSECT SELECT campaign_name FROM names WHERE platform = 'bing') AS cross_engine_pair_flag
  FROM parsed
)"""
TAXONOMY_SQL = f"{V.NAMES_SQL}, {_SPLIT_SQL}"


@query("taxonomy_search", ["platform", "campaign_id", "format", "audience_strategy", "campaign_number"],
       ctes=TAXONOMY_SQL, source="keyed WHERE platform <> 'meta'")
def taxonomy_search(spark, d):
    return X.parse_names(V.part_names(spark, d)).filter("platform <> 'meta'")


@query("taxonomy_social", ["platform", "campaign_id", "funnel_stage", "ad_product_type", "campaign_number"],
       ctes=TAXONOMY_SQL, source="keyed WHERE platform = 'meta'")
def taxonomy_social(spark, d):
    return X.parse_names(V.part_names(spark, d)).filter("platform = 'meta'")


@query("strategy_key", ["platform", "campaign_id", "strategy_key", "is_brand", "is_non_brand", "is_upper_funnel"],
       ctes=TAXONOMY_SQL, source="keyed")
def strategy_key(spark, d):
    return X.parse_names(V.part_names(spark, d))


@query("cross_engine_pairs", ["platform", "campaign_id", "campaign_name", "cross_engine_pair_flag"],
       ctes=TAXONOMY_SQL, source="keyed")
def cross_engine_pairs(spark, d):
    return X.flag_cross_engine(V.part_names(spark, d))


@query("campaign_dimension", X.DIMENSION_COLUMNS, ctes=TAXONOMY_SQL, source="keyed")
def campaign_dimension(spark, d):
    return X.parse_taxonomy(V.part_names(spark, d))


@query("unique_campaigns", ["platform", "campaign_id", "campaign_name", "channel_format"], ctes=V.FACTS_SQL,
       source="(SELECT DISTINCT platform, campaign_id, campaign_name, channel_format FROM facts)")
def unique_campaigns(spark, d):
    return X.unique_campaigns(V.facts(spark, d))


# ---- calendar --------------------------------------------------------------------------------------


def calendar_sql(days: str) -> str:
    """Calendar columns of a relation ``days(date)``; event dates from first-of-month arithmetic."""

    def nth(year, month, isodow, n):
        first = f"make_date({year}, {month}, 1)"
        return f"CAST({first} + CAST((7 + {isodow} - isodow({first})) % 7 + 7 * ({n} - 1) AS INTEGER) AS DATE)"

    def per_year(shift):
        y = f"(CAST(year(date) AS INTEGER) + {shift})"
        return y

    td = {s: nth(per_year(s), 11, 4, 4) for s in (-1, 0, 1)}
    pdays = {s: nth(per_year(s), 7, 2, 3) for s in (-1, 0, 1)}
    y = per_year(0)
    return f"""anchored AS (
  SELECT date, {td[-1]} AS td0, {td[0]} AS td1, {td[1]} AS td2,
         {pdays[-1]} AS pd0, {pdays[0]} AS pd1, {pdays[1]} AS pd2,
         {nth(y, 1, 1, 3)} AS mlk, {nth(y, 2, 1, 3)} AS pres, {nth(y, 9, 1, 1)} AS labor, {nth(y, 10, 1, 2)} AS columbus,
         CAST(make_date({y}, 5, 31) - CAST(isodow(make_date({y}, 5, 31)) - 1 AS INTEGER) AS DATE) AS memorial
  FROM {days}
), named AS (
  SELECT *, CASE
    WHEN month(date) = 1 AND day(date) = 1 THEN 'New Year''s Day' WHEN month(date) = 7 AND day(date) = 4 THEN 'Independence Day'
    WHEN month(date) = 11 AND day(date) = 11 THEN 'Veterans Day' WHEN month(date) = 12 AND day(date) = 25 THEN 'Christmas Day'
    WHEN date = mlk THEN 'Martin Luther King Jr. Day' WHEN date = pres THEN 'Presidents Day'
    WHEN date = memorial THEN 'Memorial Day' WHEN date = labor THEN 'Labor Day' WHEN date = columbus THEN 'Columbus Day'
    WHEN date = td1 THEN 'Thanksgiving Day' END AS federal
  FROM anchored
), calendar AS (
  SELECT date,
    CASE WHEN date = td1 + 1 THEN 'Black Friday' WHEN date = td1 + 4 THEN 'Cyber Monday'
         WHEN federal IS NOT NULL THEN federal WHEN date = pd1 THEN 'Prime Day (approx)' ELSE '' END AS holiday_name,
    federal IS NOT NULL AS is_holiday, date IN (td1 + 1, td1 + 4) AS is_bfcm,
    date BETWEEN td1 AND td1 + 4 AS is_cyber_week, month(date) IN (11, 12) AS is_holiday_season,
    CASE WHEN date <= td1 + 1 THEN td1 + 1 - date ELSE td2 + 1 - date END AS days_to_black_friday,
    CASE WHEN date >= td1 + 1 THEN date - (td1 + 1) ELSE date - (td0 + 1) END AS days_since_black_friday,
    CASE WHEN date <= td1 THEN td1 - date ELSE td2 - date END AS days_to_thanksgiving,
    CASE WHEN date >= td1 THEN date - td1 ELSE date - td0 END AS days_since_thanksgiving,
    round(least(1.0, greatest(
      exp(-least(abs(date - td0 - 1), abs(date - td1 - 1), abs(date - td2 - 1)) / 7.0),
      0.55 * exp(-least(abs(date - pd0), abs(date - pd1), abs(date - pd2)) / 3.0),
      CASE WHEN month(date) IN (11, 12) THEN 0.3 ELSE 0 END,
      CASE WHEN month(date) = 8 OR (month(date) = 9 AND day(date) <= 15) THEN 0.25 ELSE 0 END)), 4) AS holiday_intensity_score
  FROM named
)"""


_CALENDAR_KEYS = [c for c in CALENDAR_COLUMNS if c != "holiday_intensity_score"]
_ORDER_SPAN = """(SELECT CAST(unnest(generate_series(
    date_trunc('year', min(o_orderdate)), date_trunc('year', max(o_orderdate)) + INTERVAL 1 YEAR - INTERVAL 1 DAY,
    INTERVAL 1 DAY)) AS DATE) AS date FROM orders)"""


@query("holiday_calendar", _CALENDAR_KEYS, ["holiday_intensity_score"], source="calendar",
       ctes=calendar_sql(_ORDER_SPAN))
def holiday_calendar(spark, d):
    orders = V.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    return calendar_covering(orders)


_ORDER_DAYS = "(SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders)"


@query("days_to_events",
       ["o_orderkey", "days_to_black_friday", "days_since_black_friday", "days_to_thanksgiving", "days_since_thanksgiving"],
       ctes=calendar_sql("(SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)"),
       source=f"{_ORDER_DAYS} o JOIN calendar USING (date)")
def days_to_events(spark, d):
    date = F.col("o_orderdate").cast("date")
    return V.table(spark, d, "orders").select(
        "o_orderkey",
        D.days_until(date, D.black_friday).alias("days_to_black_friday"),
        D.days_since(date, D.black_friday).alias("days_since_black_friday"),
        D.days_until(date, D.thanksgiving).alias("days_to_thanksgiving"),
        D.days_since(date, D.thanksgiving).alias("days_since_thanksgiving"))


@query("holiday_intensity", ["o_orderkey", "federal"], ["holiday_intensity_score"],
       ctes=calendar_sql("(SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)"),
       source=f"(SELECT o_orderkey, federal, holiday_intensity_score FROM {_ORDER_DAYS} o "
              "JOIN calendar USING (date) JOIN named USING (date))")
def holiday_intensity(spark, d):
    date = F.col("o_orderdate").cast("date")
    return V.table(spark, d, "orders").select(
        "o_orderkey", D.federal_holiday(date).alias("federal"),
        D.intensity_score(date).alias("holiday_intensity_score"))


@query("calendar_parts",
       ["o_orderkey", "day_of_week", "day_of_month", "week_of_year", "month", "quarter", "year", "is_weekend"],
       source="""(SELECT o_orderkey, isodow(o_orderdate) - 1 AS day_of_week, day(o_orderdate) AS day_of_month,
         weekofyear(o_orderdate) AS week_of_year, month(o_orderdate) AS month, quarter(o_orderdate) AS quarter,
         year(o_orderdate) AS year, isodow(o_orderdate) >= 6 AS is_weekend FROM orders)""")
def calendar_parts(spark, d):
    parts = D.calendar_parts(F.col("o_orderdate").cast("date"))
    return V.table(spark, d, "orders").select("o_orderkey", *[e.alias(n) for n, e in parts.items()])

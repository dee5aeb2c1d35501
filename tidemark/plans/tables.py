"""Views of the supplied star-schema and event tables as advertising data.

A supplier plays a campaign, its region an advertising platform, a shipping day a reporting day.
Returned lines earn no revenue; tax-free lines cost nothing, which gives zero-spend days.  Every
view exists twice, as a DataFrame and as SQL text, under the same column names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import col
from tidemark.operators.harmonize import flag_maturity
from tidemark.operators.quantiles import apply_baseline, baseline_quantiles
from tidemark.session import cut_lineage, release

PLATFORMS = ["bing", "google", "meta"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def money(c: Column | str) -> Column:
    """Cents, rounded off the exact half-cent ties that products of two-decimal prices have."""
    return F.round(col(c) + F.lit(1e-5), 2)


# ---- campaigns ---------------------------------------------------------------------------

_FORMAT = "CASE s_suppkey % 4 WHEN 0 THEN 'Pmax' WHEN 1 THEN 'Search' WHEN 2 THEN 'Demand Gen' ELSE 'Shopping' END"
_AUDIENCE = "CASE s_suppkey % 3 WHEN 0 THEN '_TM' WHEN 1 THEN '_NTM' ELSE '' END"
_STAGE = "CASE s_suppkey % 3 WHEN 0 THEN 'Prospecting' WHEN 1 THEN 'Remarketing' ELSE 'Generic' END"
_PRODUCT = "CASE s_suppkey % 4 WHEN 0 THEN '_Brand' WHEN 1 THEN '_DPA' WHEN 2 THEN '_Adv_Plus' ELSE '' END"
_PLATFORM = ("CASE WHEN r_name IN ('AMERICA', 'ASIA') THEN 'google' "
             "WHEN r_name IN ('EUROPE', 'MIDDLE EAST') THEN 'meta' ELSE 'bing' END")
_NUMBER = "CAST(s_suppkey AS STRING)"
_NAME = (f"CASE WHEN r_name IN ('EUROPE', 'MIDDLE EAST') THEN concat({_STAGE}, {_PRODUCT}, '_Campaign_', {_NUMBER}) "
         f"ELSE concat({_FORMAT}, {_AUDIENCE}, '_Campaign_', {_NUMBER}) END")
_CHANNEL = (
    "CASE WHEN r_name IN ('EUROPE', 'MIDDLE EAST') THEN "
    "CASE s_suppkey % 4 WHEN 0 THEN 'Brand' WHEN 1 THEN 'Shopping' WHEN 2 THEN 'PMax' ELSE "
    "CASE s_suppkey % 3 WHEN 0 THEN 'Prospecting' WHEN 1 THEN 'Remarketing' ELSE 'Other' END END "
    "ELSE CASE s_suppkey % 4 WHEN 0 THEN 'PMax' WHEN 1 THEN 'Search' WHEN 2 THEN 'UpperFunnel' "
    "ELSE 'Shopping' END END"
)
_BUDGET = "CASE WHEN s_acctbal > 0 THEN s_acctbal END"

CAMPAIGNS_SQL = f"""campaigns AS (
  SELECT {_PLATFORM} AS platform, s_suppkey AS campaign_id, {_NAME} AS campaign_name,
         {_CHANNEL} AS channel_format, {_BUDGET} AS daily_budget
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    # 25 nations and 5 regions at every scale factor.
    places = table(spark, sf_dir, "nation").join(
        F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return table(spark, sf_dir, "supplier").join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.expr(_PLATFORM).alias("platform"),
        F.col("s_suppkey").alias("campaign_id"),
        F.expr(_NAME).alias("campaign_name"),
        F.expr(_CHANNEL).alias("channel_format"),
        F.expr(_BUDGET).alias("daily_budget"),
    )


# ---- daily facts -------------------------------------------------------------------------

DAYS_SQL = """days AS (
  SELECT l_suppkey AS campaign_id, CAST(l_shipdate AS DATE) AS date,
         round(sum(l_extendedprice * l_tax) + 1e-5, 2) AS spend,
         round(sum(CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE l_extendedprice * (1 - l_discount) END) + 1e-5, 2)
           AS revenue_attributed,
         sum(l_quantity) AS clicks, sum(l_quantity) * 100 AS impressions,
         CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS conversions
  FROM lineitem GROUP BY 1, 2
)"""


def daily_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines combined to one row per (campaign, day) before any join touches them.

    Few lines share a campaign, day and order, so combining them before the shuffle gains nothing; dealt out by
    campaign, they travel once for the sums, the distinct orders, the campaign's own columns and its windows.
    Nor does a hash table gain anything: the lines of a task are sorted once, which takes a fraction of its memory and
    can spill, and the last line of a day has the sums and, by the rank of its order, the number of orders.
    """
    price, kept = F.col("l_extendedprice"), F.col("l_returnflag") != "R"
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("campaign_id"), F.col("l_shipdate").cast("date").alias("date"), "l_orderkey", "l_quantity",
        (price * F.col("l_tax")).alias("cost"), F.when(kept, price * (1 - F.col("l_discount"))).otherwise(0.0).alias("earned"),
    )
    day = Window.partitionBy("campaign_id", "date").orderBy(F.col("l_orderkey").asc_nulls_last())
    so_far = day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = lines.repartition("campaign_id").select(
        "campaign_id", "date", "l_orderkey",
        *[F.sum(c).over(so_far).alias(c) for c in ("cost", "earned", "l_quantity")],
        F.dense_rank().over(day).alias("orders"), F.lead(F.lit(1)).over(day).isNull().alias("last"),
    )
    # Lines without an order come last and rank as one more.
    orders = F.col("orders") - F.col("l_orderkey").isNull().cast("int")
    return summed.filter("last").select(
        "campaign_id", "date",
        money("cost").alias("spend"),
        money("earned").alias("revenue_attributed"),
        F.col("l_quantity").alias("clicks"),
        (F.col("l_quantity") * 100).alias("impressions"),
        orders.cast("double").alias("conversions"),
    )


FACTS_SQL = f"""{DAYS_SQL}, {CAMPAIGNS_SQL}, unflagged AS (
  SELECT platform, campaign_id, campaign_name, date, spend, revenue_attributed, clicks, impressions,
         CASE WHEN platform <> 'meta' THEN conversions END AS conversions, daily_budget, channel_format,
         CASE WHEN platform = 'meta' THEN clicks * 2 END AS reach,
         CASE WHEN platform = 'google' THEN clicks * 3 END AS video_views
  FROM days JOIN campaigns USING (campaign_id)
), facts AS (
  SELECT u.*, date <= last_day - 14 AS attribution_mature
  FROM unflagged u JOIN (SELECT platform, max(date) AS last_day FROM unflagged GROUP BY platform) m
    USING (platform)
)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical fact table of the supplied tables."""
    dim = campaigns(spark, sf_dir)
    joined = daily_lines(spark, sf_dir).join(dim, "campaign_id")
    last_days = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("campaign_id")).agg(
        F.max("l_shipdate").cast("date").alias("date")).join(dim, "campaign_id")
    platform = F.col("platform")
    return flag_maturity(joined.select(
        "platform", "campaign_id", "campaign_name", "date", "spend", "revenue_attributed", "clicks",
        "impressions",
        F.when(platform != "meta", F.col("conversions")).alias("conversions"),
        "daily_budget", "channel_format",
        F.when(platform == "meta", F.col("clicks") * 2).alias("reach"),
        F.when(platform == "google", F.col("clicks") * 3).alias("video_views"),
    ), of=last_days)


#: Facts tables of this process, by Spark application and data folder.
_STORED: dict[tuple[str, str], DataFrame] = {}


def stored_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts for plans that read them more than once: a table that is written on first use and then shared."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _STORED:
        _STORED[key] = cut_lineage(facts(spark, sf_dir))
    # Read anew each time, so that a plan can join the facts with themselves.
    return spark.read.schema(_STORED[key].schema).parquet(_STORED[key].stored_at)


def drop_stored_facts() -> None:
    """Delete the shared tables; their queries write them again when next used."""
    while _STORED:
        release(_STORED.popitem()[1])


# ---- forecasts ---------------------------------------------------------------------------

FORECAST_SQL = f"""{FACTS_SQL}, seasonal AS (
  SELECT platform, weekday, quantile_cont(revenue_attributed, 0.1) AS p10,
         quantile_cont(revenue_attributed, 0.5) AS p50, quantile_cont(revenue_attributed, 0.9) AS p90
  FROM (SELECT *, isodow(date) - 1 AS weekday FROM facts WHERE attribution_mature) GROUP BY platform, weekday
), forecast AS (
  SELECT f.date, f.campaign_id, f.campaign_name, f.platform,
         CASE WHEN attribution_mature THEN revenue_attributed END AS revenue_attributed,
         greatest(least(p10, p50), 0) AS p10, greatest(p50, 0) AS p50, greatest(p90, p50, 0) AS p90,
         NOT attribution_mature AS is_future
  FROM facts f LEFT JOIN seasonal s ON f.platform = s.platform AND isodow(f.date) - 1 = s.weekday
)"""


def seasonal_quantiles(fact_rows: DataFrame) -> DataFrame:
    """Mature revenue quantiles by platform and weekday."""
    mature = fact_rows.filter("attribution_mature").withColumn("weekday", F.weekday("date"))
    return baseline_quantiles(mature, ["platform", "weekday"])


def forecast(spark: SparkSession, sf_dir: str, fact_rows: DataFrame | None = None) -> DataFrame:
    """Forecast table: seasonal quantiles on every row, immature rows play the future."""
    fact_rows = stored_facts(spark, sf_dir) if fact_rows is None else fact_rows
    rows = fact_rows.select(
        "date", "campaign_id", "campaign_name", "platform", F.weekday("date").alias("weekday"),
        F.when(F.col("attribution_mature"), F.col("revenue_attributed")).alias("revenue_attributed"),
        (~F.col("attribution_mature")).alias("is_future"),
    )
    scored = apply_baseline(rows, seasonal_quantiles(fact_rows), ["platform", "weekday"])
    return scored.select("date", "campaign_id", "campaign_name", "platform", "revenue_attributed",
                         "p10", "p50", "p90", "is_future")


# ---- the dense event panel -----------------------------------------------------------------

EVENT_DAYS_SQL = """event_days AS (
  SELECT event_type AS campaign_id, CAST(ts AS DATE) AS date,
         round(sum(value) + 1e-5, 2) AS revenue_attributed, CAST(count(*) AS DOUBLE) AS spend
  FROM events GROUP BY 1, 2
)"""


def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dense series per event type, January 2024."""
    return table(spark, sf_dir, "events").groupBy(
        F.col("event_type").alias("campaign_id"), F.col("ts").cast("date").alias("date")
    ).agg(
        money(F.sum("value")).alias("revenue_attributed"), F.count(F.lit(1)).cast("double").alias("spend")
    )


# ---- campaign names from parts ---------------------------------------------------------------

_PART_PLATFORM = "CASE p_partkey % 5 WHEN 0 THEN 'meta' WHEN 1 THEN 'bing' WHEN 2 THEN 'bing' ELSE 'google' END"
_PART_NAME = """CASE WHEN p_partkey % 11 = 7 THEN p_name
  WHEN p_partkey % 5 = 0 THEN concat(
    CASE p_partkey % 4 WHEN 0 THEN 'Prospecting' WHEN 1 THEN 'Remarketing' WHEN 2 THEN 'Generic' ELSE p_type END,
    CASE p_partkey % 7 WHEN 0 THEN '_Brand' WHEN 1 THEN '_DPA' WHEN 2 THEN '_Adv_Plus' WHEN 3 THEN '_' ELSE '' END,
    '_Campaign_', CASE WHEN p_partkey % 13 = 0 THEN 'x' ELSE CAST(p_size AS STRING) END)
  ELSE concat(CASE WHEN p_partkey % 17 = 0 THEN '' ELSE CASE p_partkey % 3 WHEN 0 THEN 'Demand Gen' ELSE p_type END END,
    CASE p_partkey % 3 WHEN 0 THEN '_TM' WHEN 1 THEN '_NTM' ELSE '' END,
    '_Campaign_', CASE WHEN p_partkey % 13 = 0 THEN concat(CAST(p_size AS STRING), '_Campaign_1') ELSE CAST(p_size AS STRING) END)
  END"""
_PART_CHANNEL = "CASE p_partkey % 4 WHEN 0 THEN 'UpperFunnel' WHEN 1 THEN 'PMax' ELSE 'Search' END"

NAMES_SQL = f"""names AS (
  SELECT {_PART_PLATFORM} AS platform, p_partkey AS campaign_id, {_PART_NAME} AS campaign_name,
         {_PART_CHANNEL} AS channel_format FROM part
)"""


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.expr(_PART_PLATFORM).alias("platform"), F.col("p_partkey").alias("campaign_id"),
        F.expr(_PART_NAME).alias("campaign_name"), F.expr(_PART_CHANNEL).alias("channel_format"),
    )

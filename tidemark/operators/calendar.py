"""Holiday calendar dimension: one row per day, at most 366 rows per year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import PanelError
from tidemark.functions import dates as D

LAST_YEAR = 2100  # fixed value
CALENDAR_COLUMNS = [
    "date", "holiday_name", "is_holiday", "is_bfcm", "is_cyber_week", "is_holiday_season",
    "days_to_black_friday", "days_since_black_friday",
    "days_to_thanksgiving", "days_since_thanksgiving", "holiday_intensity_score",
]


def check_years(start_year: int, end_year: int) -> None:
    for year in (start_year, end_year):
        if not isinstance(year, int) or isinstance(year, bool):
            raise TypeError(f"years must be int, got {type(year).__name__}")
    if start_year > end_year:
        raise PanelError(f"start_year {start_year} is after end_year {end_year}")
    if end_year > LAST_YEAR:
        raise PanelError(f"end_year {end_year} is after {LAST_YEAR}")


def describe_days(days: DataFrame) -> DataFrame:
    """Holiday columns of a frame of dates, from the date alone (no event tables, no joins).

    The anchor dates of the previous, current and next year are columns of their own, so that every
    flag and distance is a short expression over them.
    """
    date, year = F.col("date"), F.year("date")
    anchored = days.select(
        "date",
        D.federal_holiday(date).alias("_federal"),
        *[D.thanksgiving(year + i).alias(f"_td{i + 1}") for i in (-1, 0, 1)],
        *[D.prime_day(year + i).alias(f"_pd{i + 1}") for i in (-1, 0, 1)],
    )
    td, federal = F.col("_td1"), F.col("_federal")
    bf, cm = F.date_add(td, 1), F.date_add(td, 4)

    to_td = F.when(date <= td, F.datediff(td, date)).otherwise(F.datediff("_td2", date))
    since_td = F.when(date >= td, F.datediff(date, td)).otherwise(F.datediff(date, "_td0"))
    to_bf = F.when(date <= bf, F.datediff(bf, date)).otherwise(F.datediff("_td2", date) + 1)
    since_bf = F.when(date >= bf, F.datediff(date, bf)).otherwise(F.datediff(date, "_td0") - 1)
    measured = anchored.select(
        "date",
        F.when(date == bf, "Black Friday")
        .when(date == cm, "Cyber Monday")
        .otherwise(F.coalesce(federal, F.when(date == F.col("_pd1"), "Prime Day (approx)"), F.lit("")))
        .alias("holiday_name"),
        federal.isNotNull().alias("is_holiday"),
        ((date == bf) | (date == cm)).alias("is_bfcm"),
        date.between(td, cm).alias("is_cyber_week"),
        (F.month(date) >= 11).alias("is_holiday_season"),
        to_bf.alias("days_to_black_friday"),
        since_bf.alias("days_since_black_friday"),
        to_td.alias("days_to_thanksgiving"),
        since_td.alias("days_since_thanksgiving"),
        F.least(*[F.abs(F.datediff(date, f"_pd{i}")) for i in range(3)]).alias("_from_prime"),
    )
    score = D.blend_intensity(date, F.least("days_to_black_friday", "days_since_black_friday"), F.col("_from_prime"))
    return measured.withColumn("holiday_intensity_score", score).select(*CALENDAR_COLUMNS)


def holiday_calendar(spark: SparkSession, start_year: int = 2024, end_year: int = 2027) -> DataFrame:
    check_years(start_year, end_year)
    bounds = F.sequence(F.make_date(F.lit(start_year), F.lit(1), F.lit(1)),
                        F.make_date(F.lit(end_year), F.lit(12), F.lit(31)))
    return describe_days(spark.range(1).select(F.explode(bounds).alias("date")))


def calendar_covering(df: DataFrame, date: str = "date") -> DataFrame:
    """Calendar for the whole years a frame touches; stays lazy (min/max is part of the plan)."""
    span = df.agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    days = span.select(F.explode(F.sequence(
        F.trunc("_lo", "year"),
        F.date_sub(F.add_months(F.trunc("_hi", "year"), 12), 1),
    )).alias("date"))
    return describe_days(days)

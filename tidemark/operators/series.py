"""Per-campaign recent rows and period comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import in_last, in_prior, is_mature, last_date, total
from tidemark.roles import PANEL, Roles


def trailing_rows(df: DataFrame, n: int = 30, roles: Roles = PANEL) -> DataFrame:
    """Last n rows (not days) of each campaign."""
    w = Window.partitionBy(roles.entity).orderBy(F.col(roles.date).desc())
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def latest_rows(df: DataFrame, roles: Roles = PANEL) -> DataFrame:
    """Last row of each campaign, by a map-side combined aggregate instead of a sort."""
    newest = F.max_by(F.struct(*df.columns), F.col(roles.date))
    return df.groupBy(roles.entity).agg(newest.alias("_row")).select("_row.*")


def trailing_days(df: DataFrame, days: int, roles: Roles = PANEL) -> DataFrame:
    """Rows of the last ``days`` calendar days of the whole frame."""
    return df.filter(in_last(roles.date, last_date(df, roles.date), days))


def prior_days(df: DataFrame, days: int, roles: Roles = PANEL) -> DataFrame:
    return df.filter(in_prior(roles.date, last_date(df, roles.date), days))


def mature_rows(df: DataFrame, roles: Roles = PANEL) -> DataFrame:
    return df.filter(is_mature(df, roles.mature))


def select_campaigns(df: DataFrame, platforms=None, campaigns=None, roles: Roles = PANEL) -> DataFrame:
    """Dashboard filters; an empty selection means everything."""
    if platforms:
        df = df.filter(F.col(roles.platform).isin(list(platforms)))
    if campaigns:
        df = df.filter(F.col(roles.entity).isin(list(campaigns)))
    return df


def two_periods(
    df: DataFrame, value: str, days: int, by: list[str] | None = None, roles: Roles = PANEL,
    end: Column | None = None,
) -> DataFrame:
    """Sums over the trailing window and the one before it, in one conditional aggregation.

    Columns: the group keys, recent, prior, n_recent, n_prior.  Only the two windows are read.
    """
    end = last_date(df, roles.date) if end is None else end
    recent, prior = in_last(roles.date, end, days), in_prior(roles.date, end, days)
    return (
        df.filter(F.col(roles.date) >= F.date_sub(end, 2 * days - 1))
        .withColumn("_recent", recent)
        .withColumn("_prior", prior)
        .groupBy(*(by or []))
        .agg(
            total(F.when(F.col("_recent"), F.col(value))).alias("recent"),
            total(F.when(F.col("_prior"), F.col(value))).alias("prior"),
            F.count_if("_recent").alias("n_recent"),
            F.count_if("_prior").alias("n_prior"),
        )
    )


def period_over_period(df: DataFrame, value: str, days: int, by: list[str] | None = None,
                       roles: Roles = PANEL) -> DataFrame:
    """Recent and prior sums with the change in percent (NULL when the prior sum is not positive)."""
    change = F.when(F.col("prior") > 0, (F.col("recent") - F.col("prior")) / F.col("prior") * 100.0)
    return two_periods(df, value, days, by, roles).withColumn("change_pct", change)

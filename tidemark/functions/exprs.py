"""Small column helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import PanelError


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den, NULL when the denominator is zero or NULL (never an ANSI error)."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def ratio0(num: Column | str, den: Column | str, scale: float = 1.0) -> Column:
    """Report-style ratio: 0.0 unless the denominator is positive."""
    return F.when(col(den) > 0, F.try_divide(col(num) * F.lit(scale), col(den))).otherwise(F.lit(0.0))


def no_nan(c: Column | str) -> Column:
    """Missing is NULL in this library; NaN would poison avg/max and sort above everything."""
    return F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))


def settled(c: Column | str, digits: int = 4) -> Column:
    """Rounding that does not depend on summation order: step off exact ties, then round."""
    return F.round(col(c) + F.lit(1e-7), digits)


def total(c: Column | str) -> Column:
    """Sum that is 0.0 over nothing, as report tables expect."""
    return F.coalesce(F.sum(col(c)), F.lit(0.0))


def value_map(mapping: Mapping[str, str], c: Column | str, default: str) -> Column:
    """Value mapping with a default that also covers NULL input."""
    c = col(c)
    out = F.lit(default)
    for key, value in reversed(list(mapping.items())):
        out = F.when(c == key, F.lit(value)).otherwise(out)
    return out


def require_columns(df: DataFrame, columns, what: str = "input") -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise PanelError(f"{what} is missing columns: {missing}")


# ---- dates relative to the end of the data ---------------------------------------------


def last_date(df: DataFrame, date: str = "date") -> Column:
    """max(date) as a scalar subquery: no join, no driver round trip, pushed below aggregates."""
    return df.agg(F.max(date)).scalar()


def in_last(date: Column | str, end: Column, days: int) -> Column:
    """The trailing window of ``days`` calendar days that ends at ``end``."""
    return col(date) >= F.date_sub(end, days - 1)


def in_prior(date: Column | str, end: Column, days: int) -> Column:
    """The ``days`` calendar days before the trailing window."""
    date = col(date)
    return (date >= F.date_sub(end, 2 * days - 1)) & (date <= F.date_sub(end, days))


def is_mature(df: DataFrame, mature: str = "attribution_mature") -> Column:
    """NULL counts as immature; without the column every row is mature."""
    if mature not in df.columns:
        return F.lit(True)
    return F.coalesce(F.col(mature), F.lit(False))


def feature_names(df: DataFrame, excluded) -> list[str]:
    return [c for c in df.columns if c not in excluded]

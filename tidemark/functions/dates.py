"""Calendar arithmetic as column expressions: US events are functions of the year alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.exprs import col

# --- fixed values: weekday numbers, holiday rules, intensity constants ------------------
MON, TUE, THU = 0, 1, 3
NEXT_DAY_NAMES = ["MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN"]

# (name, month, day)
FIXED_HOLIDAYS = [
    ("New Year's Day", 1, 1),
    ("Independence Day", 7, 4),
    ("Veterans Day", 11, 11),
    ("Christmas Day", 12, 25),
]
# (name, month, weekday, n); n = -1 is the last one of the month
FLOATING_HOLIDAYS = [
    ("Martin Luther King Jr. Day", 1, MON, 3),
    ("Presidents Day", 2, MON, 3),
    ("Memorial Day", 5, MON, -1),
    ("Labor Day", 9, MON, 1),
    ("Columbus Day", 10, MON, 2),
    ("Thanksgiving Day", 11, THU, 4),
]
BFCM_DECAY_DAYS = 7.0
PRIME_DECAY_DAYS = 3.0
PRIME_PEAK = 0.55
SEASON_FLOOR = 0.30
BACK_TO_SCHOOL_FLOOR = 0.25
# ---------------------------------------------------------------------------------------


def nth_weekday(year: Column | int, month: int, weekday: int, n: int) -> Column:
    """n-th given weekday of a month; raises at run time when the month has no such day."""
    first = F.make_date(_year(year), F.lit(month), F.lit(1))
    hit = F.date_add(F.next_day(F.date_sub(first, 1), NEXT_DAY_NAMES[weekday]), 7 * (n - 1))
    if n <= 4:
        return hit
    return F.when(F.month(hit) == month, hit).otherwise(
        F.raise_error(F.concat(F.lit(f"no {n}-th {NEXT_DAY_NAMES[weekday]} in month {month} of "),
                               _year(year).cast("string"))).cast("date")
    )


def last_weekday(year: Column | int, month: int, weekday: int) -> Column:
    end = F.last_day(F.make_date(_year(year), F.lit(month), F.lit(1)))
    back = F.pmod(F.weekday(end) - F.lit(weekday), F.lit(7))
    return F.date_sub(end, back)


def _year(year: Column | int) -> Column:
    return F.lit(year) if isinstance(year, int) else year


def thanksgiving(year: Column | int) -> Column:
    return nth_weekday(year, 11, THU, 4)


def black_friday(year: Column | int) -> Column:
    return F.date_add(thanksgiving(year), 1)


def cyber_monday(year: Column | int) -> Column:
    return F.date_add(thanksgiving(year), 4)


def prime_day(year: Column | int) -> Column:
    return nth_weekday(year, 7, TUE, 3)


def federal_holiday(date: Column | str) -> Column:
    """Name of the federal holiday on this date, else NULL."""
    date = col(date)
    out = F.lit(None).cast("string")
    for name, month, day in FIXED_HOLIDAYS:
        out = F.when((F.month(date) == month) & (F.dayofmonth(date) == day), name).otherwise(out)
    for name, month, weekday, n in FLOATING_HOLIDAYS:
        year = F.year(date)
        hit = last_weekday(year, month, weekday) if n < 0 else nth_weekday(year, month, weekday, n)
        out = F.when(date == hit, name).otherwise(out)
    return out


def days_until(date: Column | str, event) -> Column:
    """Days to the nearest event on or after the date; ``event`` maps a year to its date."""
    date = col(date)
    this_year = event(F.year(date))
    upcoming = F.when(date <= this_year, this_year).otherwise(event(F.year(date) + 1))
    return F.datediff(upcoming, date)


def days_since(date: Column | str, event) -> Column:
    """Days from the nearest event on or before the date."""
    date = col(date)
    this_year = event(F.year(date))
    latest = F.when(date >= this_year, this_year).otherwise(event(F.year(date) - 1))
    return F.datediff(date, latest)


def blend_intensity(date: Column, from_bf: Column, from_prime: Column) -> Column:
    """Holiday intensity in [0, 1]: the strongest of four effects, 4 decimals half-even."""
    month, day = F.month(date), F.dayofmonth(date)
    raw = F.greatest(
        F.exp(-from_bf / F.lit(BFCM_DECAY_DAYS)),
        F.lit(PRIME_PEAK) * F.exp(-from_prime / F.lit(PRIME_DECAY_DAYS)),
        F.when(month >= 11, F.lit(SEASON_FLOOR)).otherwise(F.lit(0.0)),
        F.when((month == 8) | ((month == 9) & (day <= 15)), F.lit(BACK_TO_SCHOOL_FLOOR))
        .otherwise(F.lit(0.0)),
    )
    return F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)), 4)


def intensity_score(date: Column | str) -> Column:
    """Intensity of any date column; events of the neighbouring years count."""
    date = col(date)
    from_bf = F.least(days_until(date, black_friday), days_since(date, black_friday))
    from_prime = F.least(days_until(date, prime_day), days_since(date, prime_day))
    return blend_intensity(date, from_bf, from_prime)


def calendar_parts(date: Column | str = "date") -> dict[str, Column]:
    date = col(date)
    return {
        "day_of_week": F.weekday(date),
        "day_of_month": F.dayofmonth(date),
        "week_of_year": F.weekofyear(date),
        "month": F.month(date),
        "quarter": F.quarter(date),
        "year": F.year(date),
        "is_weekend": F.weekday(date) >= 5,
    }

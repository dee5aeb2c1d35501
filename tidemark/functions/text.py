"""Message text: templates filled from columns, and number formats."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.exprs import col


def fill(template: str, **values: Column | str) -> Column:
    """Concatenate a template's literal text with string columns named in braces."""
    parts = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field:
            value = values[field]
            parts.append(F.lit(value) if isinstance(value, str) else value.cast("string"))
    return F.concat(*parts)


def whole(c: Column | str) -> Column:
    """1234567.8 -> 1,234,568"""
    return F.format_number(col(c), 0)


def fixed(c: Column | str, digits: int = 1, signed: bool = False) -> Column:
    """Fixed decimals without separators, exact ties to even (format_string would round them up)."""
    c = col(c).cast("double")
    text = F.replace(F.format_number(c, digits), F.lit(","), F.lit(""))
    return F.concat(F.when(c >= 0, "+").otherwise(""), text) if signed else text


def percent(share: Column | str) -> Column:
    """0.123 -> 12%"""
    return F.concat(fixed(col(share) * 100.0, 0), F.lit("%"))


def titled(c: Column | str) -> Column:
    return F.initcap(col(c))

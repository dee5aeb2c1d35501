"""Campaign-name parsing as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.exprs import col

# --- fixed values: naming conventions ---------------------------------------------------
TOKEN = "_Campaign_"
SOCIAL_PREFIX = r"^(Prospecting|Remarketing|Generic)(?:_([\s\S]*))?$"
INTEGER = r"^\s*[+-]?\d+\s*$"
META_CHANNEL_RULES = [  # strongest first
    ("Adv_Plus", "PMax"),
    ("DPA", "Shopping"),
    ("Brand", "Brand"),
    ("Remarketing", "Remarketing"),
    ("Prospecting", "Prospecting"),
]
# ---------------------------------------------------------------------------------------


def _blank_to_null(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def has_token(name: Column | str) -> Column:
    return F.instr(col(name), TOKEN) > 0


def prefix(name: Column | str) -> Column:
    """Everything before the first token."""
    name = col(name)
    return F.substring(name, F.lit(1), F.instr(name, TOKEN) - 1)


def campaign_number(name: Column | str) -> Column:
    """Integer after the first token, NULL when there is none."""
    name = col(name)
    tail = F.substring(name, F.instr(name, TOKEN) + len(TOKEN), F.length(name))
    return F.when(has_token(name) & tail.rlike(INTEGER), F.trim(tail).try_cast("int"))


def audience_strategy(name: Column | str) -> Column:
    head = prefix(name)
    return F.when(has_token(name), F.when(head.endswith("_NTM"), "NTM").when(head.endswith("_TM"), "TM"))


def search_format(name: Column | str) -> Column:
    """Ad format of a search-engine campaign; an unparsable name is its own format."""
    name = col(name)
    return F.when(has_token(name), _blank_to_null(F.regexp_replace(prefix(name), "_N?TM$", ""))).otherwise(name)


def funnel_stage(name: Column | str) -> Column:
    return F.when(has_token(name), _blank_to_null(F.regexp_extract(prefix(name), SOCIAL_PREFIX, 1)))


def ad_product_type(name: Column | str) -> Column:
    return F.when(has_token(name), _blank_to_null(F.regexp_extract(prefix(name), SOCIAL_PREFIX, 2)))


def strategy_key(platform: Column | str, part1: Column | str, part2: Column | str) -> Column:
    """Underscore-joined key of the non-empty parts, spaces replaced."""
    parts = [_blank_to_null(F.replace(col(p), F.lit(" "), F.lit("_"))) for p in (part1, part2)]
    return F.concat_ws("_", col(platform), *parts)


def meta_channel(name: Column | str) -> Column:
    name = col(name)
    out = F.lit("Other")
    for needle, channel in reversed(META_CHANNEL_RULES):
        out = F.when(name.contains(needle), channel).otherwise(out)
    return out


def segment(label: Column | str) -> Column:
    """TM when the label marks a trademark or brand campaign, else NTM."""
    label = F.upper(col(label).cast("string"))
    return F.when(label.contains("_TM_") | label.contains("BRAND"), "TM").otherwise("NTM")

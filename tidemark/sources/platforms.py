"""Platform CSV exports: read as text, cast by column NAME, checked against a contract.

Spark applies a user schema to CSV columns by position, which silently misreads files whose
columns are ordered differently, so the readers never pass one.  Bad values fail the query in
the same pass that reads them; ``cast_failures`` counts them instead when an audit is wanted.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import SourceError

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Contract:
    """Declared columns of one platform export."""

    source: str
    filename: str
    date: str
    entity: str
    types: dict[str, str]


# --- fixed values: export schemas, missing-value markers, date patterns -----------------
GOOGLE = Contract(
    "google", "google_ads_campaign_stats.csv", "segments_date", "campaign_id",
    {
        "campaign_id": "bigint",
        "segments_date": "date",
        "metrics_clicks": "bigint",
        "metrics_conversions": "double",
        "metrics_cost_micros": "bigint",
        "metrics_impressions": "bigint",
        "metrics_video_views": "bigint",
        "metrics_conversions_value": "double",
        "campaign_advertising_channel_type": "string",
        "campaign_budget_amount": "double",
        "campaign_name": "string",
    },
)
META = Contract(
    "meta", "meta_ads_campaign_stats.csv", "date_start", "campaign_id",
    {
        "campaign_id": "bigint",
        "date_start": "date",
        "cpc": "double",
        "cpm": "double",
        "ctr": "double",
        "reach": "double",
        "spend": "double",
        "clicks": "double",
        "impressions": "double",
        "conversion": "double",
        "daily_budget": "double",
        "campaign_name": "string",
    },
)
BING = Contract(
    "bing", "bing_campaign_stats.csv", "TimePeriod", "CampaignId",
    {
        "CampaignId": "bigint",
        "TimePeriod": "date",
        "Revenue": "double",
        "Spend": "double",
        "Clicks": "bigint",
        "Impressions": "bigint",
        "Conversions": "double",
        "CampaignType": "string",
        "DailyBudget": "double",
        "CampaignName": "string",
    },
)
CONTRACTS = {c.source: c for c in (GOOGLE, META, BING)}

INDEX_COLUMN = "_c0"  # Spark's name for the blank header of an exported row index
MISSING = ["", "NA", "N/A", "NaN", "nan", "NULL", "null", "None", "<NA>", "n/a", "#N/A"]
DATE_PATTERNS = [
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "M/d/yyyy",
    "yyyyMMdd", "d MMM yyyy", "MMM d, yyyy",
]
# ---------------------------------------------------------------------------------------


def _text(name: str) -> Column:
    raw = F.trim(F.col(f"`{name}`"))
    return F.when(~raw.isin(MISSING), raw)


def _may_fit(raw: Column, pattern: str) -> Column:
    """What every text of a pattern has: a failed attempt to parse costs far more than this look."""
    if pattern == "yyyyMMdd":
        return ~raw.rlike("[-/ ,:T]")
    if pattern == "yyyy/MM/dd":
        return F.instr(raw, "/") > 4
    separators = "".join("%" + c if c in "-/ ,:T" else "" for c in pattern) + "%"
    fits = raw.like(separators)
    # The shorter patterns of two that begin alike are told by what the longer ones have besides.
    return fits & ~raw.contains({"yyyy-MM-dd": ":", "d MMM yyyy": ","}[pattern]) if pattern in ("yyyy-MM-dd", "d MMM yyyy") else fits


def parse_date(raw: Column) -> Column:
    """Strict ISO first, then the other patterns; NULL when none fits."""
    return F.coalesce(*[F.when(_may_fit(raw, p), F.try_to_timestamp(raw, F.lit(p))) for p in DATE_PATTERNS]).cast("date")


def _typed(name: str, kind: str) -> Column:
    raw = _text(name)
    if kind == "string":
        return raw
    return parse_date(raw) if kind == "date" else raw.try_cast(kind)


def _strict(contract: Contract, name: str, kind: str) -> Column:
    value = _typed(name, kind)
    bad = _text(name).isNotNull() & value.isNull()
    if kind == "bigint":  # integer columns have no missing values
        bad = bad | value.isNull()
    message = F.concat(
        F.lit(f"{contract.source}: cannot read column {name} as {kind}: "),
        F.coalesce(F.col(f"`{name}`"), F.lit("<missing>")),
    )
    return value if kind == "string" else F.when(bad, F.raise_error(message).cast(kind)).otherwise(value)


def read_text(spark: SparkSession, path) -> DataFrame:
    """All columns as strings, the exported row index dropped."""
    raw = spark.read.csv(path, header=True)
    if INDEX_COLUMN not in raw.columns:
        log.warning("no exported row index in %s", path)
    return raw.drop(INDEX_COLUMN)


def check_columns(contract: Contract, columns) -> list[str]:
    """Raise on missing columns; return the unexpected ones, which are carried through."""
    missing = sorted(set(contract.types) - set(columns))
    if missing:
        raise SourceError(f"{contract.source}: missing columns {missing}; found {sorted(columns)}")
    extra = [c for c in columns if c not in contract.types]
    if extra:
        log.warning("%s: unexpected columns carried through: %s", contract.source, extra)
    return extra


def conform(raw: DataFrame, contract: Contract) -> DataFrame:
    """Cast a text frame to its contract, failing on values that do not fit."""
    extra = check_columns(contract, raw.columns)
    typed = [_strict(contract, n, k).alias(n) for n, k in contract.types.items()]
    return raw.select(*typed, *[F.col(f"`{c}`") for c in extra])


def cast_failures(raw: DataFrame, contract: Contract) -> DataFrame:
    """(source, column_name, n_bad) of values the contract's types cannot hold."""
    check_columns(contract, raw.columns)
    checked = [(n, k) for n, k in contract.types.items() if k != "string"]
    counts = raw.agg(
        *[F.count_if(_text(n).isNotNull() & _typed(n, k).isNull()).alias(n) for n, k in checked]
    )
    names = [n for n, _ in checked]
    return (
        counts.unpivot([], names, "column_name", "n_bad")
        .filter("n_bad > 0")
        .select(F.lit(contract.source).alias("source"), "column_name", "n_bad")
    )


def read_platform(spark: SparkSession, path, contract: Contract) -> DataFrame:
    """One platform export (a file, a glob or a folder of files with the same header)."""
    return conform(read_text(spark, path), contract)


def read_google(spark: SparkSession, path) -> DataFrame:
    return read_platform(spark, path, GOOGLE)


def read_meta(spark: SparkSession, path) -> DataFrame:
    return read_platform(spark, path, META)


def read_bing(spark: SparkSession, path) -> DataFrame:
    return read_platform(spark, path, BING)


def read_all(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The three exports of a folder under their standard file names."""
    base = folder.rstrip("/")
    return {s: read_platform(spark, f"{base}/{c.filename}", c) for s, c in CONTRACTS.items()}


def profile(sources: dict[str, tuple[DataFrame, str, str]], approximate: bool = False) -> DataFrame:
    """One row per source: size, date range, distinct campaigns, columns with NULLs.

    ``sources`` maps a label to (frame, date column, entity column).  Each source is one
    aggregation pass; ``approximate`` swaps the exact distinct count for a sketch.
    """
    rows = None
    for label, (df, date, entity) in sources.items():
        distinct = F.approx_count_distinct(entity) if approximate else F.count_distinct(F.col(entity))
        nulls = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"_null_{i}") for i, c in enumerate(df.columns)]
        agg = df.agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.min(date).cast("date").alias("min_date"),
            F.max(date).cast("date").alias("max_date"),
            distinct.alias("n_campaigns"),
            *nulls,
        )
        named = [F.when(F.col(f"_null_{i}") > 0, F.lit(c)) for i, c in enumerate(df.columns)]
        counts = [F.col(f"_null_{i}") for i in range(len(df.columns))]
        row = agg.select(
            F.lit(label).alias("source"),
            "n_rows",
            F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
            "min_date",
            "max_date",
            "n_campaigns",
            sum(counts, F.lit(0)).cast("bigint").alias("n_null_cells"),
            F.concat_ws(",", *named).alias("null_columns"),
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows

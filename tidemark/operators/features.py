"""Feature store: lags, trailing windows, momentum, joins and row-level features.

All window features share ONE specification (campaign, ordered by day), so Catalyst plans one
shuffle and one sort for the whole block.  A window group is one campaign's history, which the
(campaign, day) grain bounds by the number of days covered (3 653 rows per decade) however many
raw rows the campaign has: raw rows are pre-aggregated to days before they reach this module.

A sliding frame of Spark walks over its whole window anew for every row and aggregate.  The store
therefore takes its rows in window order, numbered by Spark, and adds them up in numpy for many rows at a
time (``lagged_and_rolled``), in the order in which the frames would.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.dates import calendar_parts
from tidemark.functions.exprs import ratio, require_columns
from tidemark.operators.calendar import calendar_covering
from tidemark.operators.quality import enforce, feature_store_violations
from tidemark.operators.taxonomy import parse_taxonomy
from tidemark.roles import (
    BUDGET_COLUMNS, HOLIDAY_COLUMNS, LAG_SPEC, MOMENTUM_SPEC, PANEL, ROAS_LAGS, ROLLING_SPEC,
    TAXONOMY_COLUMNS, Roles, lag_columns, momentum_columns, roas_columns, rolling_columns, stem,
)

_AGGREGATES = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def _by_day(roles: Roles, mode: str):
    """Campaign window over rows (feature store) or over calendar days (rollout semantics)."""
    w = Window.partitionBy(roles.entity)
    if mode == "rows":
        return w.orderBy(roles.date)
    if mode == "days":
        return w.orderBy(F.unix_date(roles.date))
    raise ValueError(f"mode must be 'rows' or 'days', got {mode!r}")


def lag_features(df: DataFrame, spec=None, roles: Roles = PANEL, mode: str = "rows") -> DataFrame:
    """``{stem}_lag_{n}``: the value n rows (or exactly n days) earlier in the same campaign."""
    spec = LAG_SPEC if spec is None else spec
    require_columns(df, {*roles.grain, *spec})
    w = _by_day(roles, mode)
    new = {}
    for c, lags in spec.items():
        for n in lags:
            value = F.lag(c, n).over(w) if mode == "rows" else F.max(c).over(w.rangeBetween(-n, -n))
            new[f"{stem(c)}_lag_{n}"] = value
    return df.withColumns(new)


def rolling_features(df: DataFrame, spec=None, roles: Roles = PANEL, mode: str = "rows") -> DataFrame:
    """``{stem}_roll_{agg}_{w}`` over the w rows (or days) before today; today never counts."""
    spec = ROLLING_SPEC if spec is None else spec
    require_columns(df, {*roles.grain, *spec})
    w = _by_day(roles, mode)
    new = {}
    for c, aggs in spec.items():
        for agg, windows in aggs.items():
            for k in windows:
                frame = w.rowsBetween(-k, -1) if mode == "rows" else w.rangeBetween(-k, -1)
                new[f"{stem(c)}_roll_{agg}_{k}"] = _AGGREGATES[agg](c).over(frame)
    return df.withColumns(new)


def _before(x: np.ndarray, places: np.ndarray | None, first: int, j: int) -> np.ndarray:
    """The values j rows before ``places``, or before every row from ``first`` on."""
    return x[first - j:len(x) - j] if places is None else x[places - j]


def _over_rows(x: np.ndarray, ok: np.ndarray, at: np.ndarray, agg: str, k: int, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(values, whether there is one) of ``agg`` over the k rows before each; ``at`` numbers a campaign's rows from 1.

    ``x`` and ``ok`` begin with rows that came before those of ``at``, which stand at ``places``, at the end by default.
    """
    size, first = len(at), len(x) - len(at)
    n, mean, off = np.zeros(size), np.zeros(size), np.zeros(size)
    least, most = np.full(size, np.nan), np.full(size, -np.inf)
    for j in range(k, 0, -1):
        value, there = _before(x, places, first, j), _before(ok, places, first, j) & (at > j)
        n += there
        if agg == "mean":
            mean += np.where(there, value, 0.0)
        elif agg == "std":
            step = np.where(there, value - mean, 0.0)
            share = step / np.maximum(n, 1.0)
            mean += share
            off += step * (step - share)
        elif agg == "min":
            least = np.fmin(least, np.where(there, value, np.nan))
        else:
            most = np.maximum(most, np.where(there, value, -np.inf))
    if agg == "mean":
        return mean / np.maximum(n, 1.0), n > 0
    if agg == "std":
        return np.sqrt(off / np.maximum(n - 1.0, 1.0)), n > 1
    return (least if agg == "min" else most), n > 0


def lagged_and_rolled(df: DataFrame, lags=None, rolls=None, roles: Roles = PANEL, keep: Column | None = None) -> DataFrame:
    """``rolling_features(lag_features(df))`` by rows: the same columns, each batch of rows in one go.

    Spark numbers the rows of a campaign by day and hands them over in that order; a batch keeps as many rows
    of the one before it as the longest window has.  ``keep`` says which rows are wanted; the others are only
    looked back on.
    """
    lags, rolls = LAG_SPEC if lags is None else lags, ROLLING_SPEC if rolls is None else rolls
    measures = list(dict.fromkeys([*lags, *rolls]))
    require_columns(df, {*roles.grain, *measures})
    if any(not isinstance(df.schema[c].dataType, T.DoubleType) for c in measures) or "_at" in df.columns:
        out = rolling_features(lag_features(df, lags, roles), rolls, roles)
        return out if keep is None else out.withColumn("_keep", keep).filter("_keep").drop("_keep")
    names, new = df.columns, lag_columns(lags) + rolling_columns(rolls)
    some = keep is not None
    longest = max([n for ns in lags.values() for n in ns] + [k for aggs in rolls.values() for ks in aggs.values() for k in ks])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: (np.full(longest, np.nan), np.zeros(longest, bool)) for c in measures}
        last = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column("_at").to_numpy()
            if not some and not ((at == 1) | (at == np.concatenate([[last], at[:-1]]) + 1)).all():
                raise ValueError("rows of a campaign did not arrive in the order of their days")
            last, columns, places = at[-1], {}, None
            if some:
                rows = np.flatnonzero(batch.column("_keep").to_numpy(zero_copy_only=False))
                places, at = longest + rows, at[rows]
            for c in measures:
                value = batch.column(c)
                x = np.concatenate([held[c][0], value.to_numpy(zero_copy_only=False)])
                ok = np.concatenate([held[c][1], value.is_valid().to_numpy(zero_copy_only=False)])
                held[c] = x[-longest:], ok[-longest:]
                if not len(at):
                    continue
                for n in lags.get(c, ()):
                    columns[f"{stem(c)}_lag_{n}"] = _before(x, places, longest, n), _before(ok, places, longest, n) & (at > n)
                for agg, windows in rolls.get(c, {}).items():
                    for k in windows:
                        columns[f"{stem(c)}_roll_{agg}_{k}"] = _over_rows(x, ok, at, agg, k, places)
            if not columns:
                continue
            batch = batch.take(pa.array(rows)) if some else batch
            found = [pa.array(v, mask=~there) for v, there in (columns[c] for c in new)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *found], [*names, *new])

    numbered = df.withColumn("_at", F.row_number().over(_by_day(roles, "rows")))
    if some:
        # Rows that no wanted one looks back on stay behind; what precedes a wanted row is whole.
        ahead = _by_day(roles, "rows").rowsBetween(0, longest)
        numbered = numbered.withColumn("_keep", F.coalesce(keep, F.lit(False))).withColumn("_near", F.max("_keep").over(ahead)).filter("_near")
    return numbered.mapInArrow(run, T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in new]]))


def momentum(df: DataFrame, spec=None) -> DataFrame:
    """Yesterday relative to the trailing mean; NULL where that mean is zero."""
    spec = MOMENTUM_SPEC if spec is None else spec
    require_columns(df, [f"{p}_lag_1" for p in spec] + [f"{p}_roll_mean_{w}" for p in spec for w in spec[p]])
    return df.withColumns({
        f"{p}_momentum_{w}": ratio(f"{p}_lag_1", f"{p}_roll_mean_{w}")
        for p, windows in spec.items() for w in windows
    })


def roas_lags(df: DataFrame, windows=ROAS_LAGS) -> DataFrame:
    return df.withColumns({
        f"roas_lag_{w}": ratio(f"revenue_lag_{w}", f"spend_lag_{w}") for w in windows
    })


def calendar_features(df: DataFrame, roles: Roles = PANEL) -> DataFrame:
    return df.withColumns(calendar_parts(roles.date))


def budget_features(df: DataFrame, roles: Roles = PANEL) -> DataFrame:
    return df.withColumns({
        "budget_utilization": ratio(roles.spend, roles.budget),
        "budget_headroom": F.col(roles.budget) - F.col(roles.spend),
    })


def join_taxonomy(df: DataFrame, dim: DataFrame, roles: Roles = PANEL, unique: bool = False) -> DataFrame:
    """Left join of the campaign dimension, first reduced to one row per key unless ``unique``.

    The join key is (platform, campaign), but the panel is already partitioned by campaign.  The
    dimension therefore folds to one row per campaign id with an entry per platform, so that wide
    rows are not shuffled again.  No broadcast hint: the dimension grows with the number of
    campaigns, and its measured size decides.
    """
    keys = [roles.platform, roles.entity]
    slim = dim.filter(F.col(roles.platform).isNotNull()).select(*keys, F.struct(*TAXONOMY_COLUMNS).alias("_t"))
    slim = slim if unique else slim.dropDuplicates(keys)
    per_id = slim.groupBy(roles.entity).agg(
        F.map_from_entries(F.collect_list(F.struct(roles.platform, "_t"))).alias("_by_platform")
    )
    matched = F.try_element_at("_by_platform", F.col(roles.platform))
    return df.join(per_id, roles.entity, "left").withColumn("_t", matched).select(*df.columns, "_t.*")


def join_calendar(df: DataFrame, calendar: DataFrame, roles: Roles = PANEL) -> DataFrame:
    """Left join by day; the calendar has at most 366 rows a year, so it is broadcast."""
    slim = calendar.select(F.col("date").cast("date").alias(roles.date), *HOLIDAY_COLUMNS)
    return df.withColumn(roles.date, F.col(roles.date).cast("date")).join(
        F.broadcast(slim), roles.date, "left"
    )


def build_feature_store(
    facts: DataFrame,
    taxonomy: DataFrame | None = None,
    calendar: DataFrame | None = None,
    check: bool = False,
    mode: str = "rows",
    keep: Column | None = None,
) -> DataFrame:
    """The wide feature table: one row per (campaign, day), canonical columns first.

    ``keep`` says which of the facts get a row; lags and windows see all of them.
    """
    derived = taxonomy is None  # has one row per campaign by construction
    taxonomy = parse_taxonomy(facts) if derived else taxonomy
    calendar = calendar_covering(facts) if calendar is None else calendar
    # The dimension joins before the windows: they keep the order of rows, but not the partitioning by campaign.
    fs = join_taxonomy(facts, taxonomy, unique=derived)
    if mode == "rows":
        fs = lagged_and_rolled(fs, keep=keep)
    else:
        fs = rolling_features(lag_features(fs, mode=mode), mode=mode)
        fs = fs if keep is None else fs.withColumn("_keep", keep).filter("_keep")
    fs = join_calendar(momentum(fs), calendar)
    fs = roas_lags(budget_features(calendar_features(fs)))
    parts = list(calendar_parts("date"))
    fs = fs.select(
        *facts.columns, *lag_columns(), *rolling_columns(), *momentum_columns(), *TAXONOMY_COLUMNS,
        *HOLIDAY_COLUMNS, *parts, *BUDGET_COLUMNS, *roas_columns(),
    )
    if check:
        enforce(feature_store_violations(fs), fs)
    return fs

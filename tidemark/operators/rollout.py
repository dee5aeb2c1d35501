"""Recursive multi-day forecast: each day's P50 becomes the next day's history.

The state is one row per campaign: its last feature row and the last 60 calendar days of revenue
as a fixed-length array (NULL where a day is missing).  The days cost no shuffles after the state is
built.  A model that can be evaluated on arrays (the quantile forest) runs all days of a batch of
campaigns inside one task, so that the whole forecast is one stage; any other model is applied to
the state day by day, as a row-level projection.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import QualityError
from tidemark.functions.dates import calendar_parts
from tidemark.functions.exprs import ratio
from tidemark.operators.backtest import score_recent
from tidemark.operators.quality import forecast_violations
from tidemark.operators.reports import union_future
from tidemark.roles import LAG_SPEC, MOMENTUM_SPEC, PANEL, ROAS_LAGS, ROLLING_SPEC, Roles
from tidemark.session import cut_lineage

BUFFER_DAYS = 60  # fixed value: history a step can look back on
FORECAST_COLUMNS = ["date", "campaign_id", "campaign_name", "platform", "revenue_attributed",
                    "p10", "p50", "p90", "is_future"]


def rollout_state(fs: DataFrame, last_day: dt.date, roles: Roles = PANEL) -> DataFrame:
    """Last row and revenue buffer of every campaign, in one aggregation that combines map-side."""
    back = F.datediff(F.lit(last_day), F.col(roles.date))
    slots = [F.max(F.when(back == i, F.col(roles.revenue))) for i in reversed(range(BUFFER_DAYS))]
    return fs.groupBy(F.col(roles.entity).alias("_id")).agg(
        F.max_by(F.struct(*fs.columns), F.col(roles.date)).alias("_row"),
        F.array(*slots).alias("_buf"),
    ).select("_row.*", "_buf")


def _window(buf: Column, days: int) -> Column:
    return F.array_compact(F.slice(buf, BUFFER_DAYS - days + 1, days))


def _mean(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def _std(values: Column) -> Column:
    mean = _mean(values)
    squares = F.aggregate(F.transform(values, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) >= 2, F.sqrt(F.try_divide(squares, F.size(values) - 1)))


def revenue_features(buf: Column | str, columns: list[str]) -> dict[str, Column]:
    """Date-addressed revenue lags and trailing windows of the day after the buffer ends."""
    buf = F.col(buf) if isinstance(buf, str) else buf
    out = {f"revenue_lag_{n}": F.element_at(buf, -n) for n in LAG_SPEC["revenue_attributed"]}
    stats = {"mean": _mean, "std": _std, "min": F.array_min, "max": F.array_max}
    for agg, windows in ROLLING_SPEC["revenue_attributed"].items():
        for w in windows:
            out[f"revenue_roll_{agg}_{w}"] = stats[agg](_window(buf, w))
    return {c: e for c, e in out.items() if c in columns}


def _running(values: np.ndarray) -> np.ndarray:
    """Row sums from left to right, the order in which ``F.aggregate`` adds."""
    return np.add.accumulate(values, axis=1)[:, -1]


def _over(num: np.ndarray, den: np.ndarray) -> np.ndarray:
    """num / den, NaN where the denominator is zero or missing."""
    return np.divide(num, den, out=np.full(len(num), np.nan), where=np.nan_to_num(den) != 0)


def revenue_arrays(buf: np.ndarray, columns: list[str]) -> dict[str, np.ndarray]:
    """``revenue_features`` of (campaign, day) arrays, NaN where a day is missing."""
    out = {f"revenue_lag_{n}": buf[:, -n] for n in LAG_SPEC["revenue_attributed"]}
    wanted = {w for windows in ROLLING_SPEC["revenue_attributed"].values() for w in windows}
    stats: dict[tuple[str, int], np.ndarray] = {}
    for w in wanted:
        part = buf[:, BUFFER_DAYS - w:]
        there = ~np.isnan(part)
        n = there.sum(axis=1).astype(float)
        mean = _over(_running(np.where(there, part, 0.0)), n)
        off = np.where(there, part - mean[:, None], 0.0)
        stats["mean", w] = mean
        stats["std", w] = np.sqrt(np.where(n >= 2, _over(_running(off * off), n - 1), np.nan))
        stats["min", w] = np.where(n > 0, np.where(there, part, np.inf).min(axis=1), np.nan)
        stats["max", w] = np.where(n > 0, np.where(there, part, -np.inf).max(axis=1), np.nan)
    for agg, windows in ROLLING_SPEC["revenue_attributed"].items():
        out |= {f"revenue_roll_{agg}_{w}": stats[agg, w] for w in windows}
    return {c: v for c, v in out.items() if c in columns}


def _derived(found: dict[str, np.ndarray], columns: list[str]) -> dict[str, np.ndarray]:
    """Momentum and lagged returns out of the step's own lags and windows."""
    pairs = {f"revenue_momentum_{w}": ("revenue_lag_1", f"revenue_roll_mean_{w}") for w in MOMENTUM_SPEC["revenue"]}
    pairs |= {f"roas_lag_{w}": (f"revenue_lag_{w}", f"spend_lag_{w}") for w in ROAS_LAGS}
    return {c: _over(found[a], found[b]) for c, (a, b) in pairs.items() if c in columns and a in found and b in found}


def rolled(state: DataFrame, model, last_day: dt.date, n_days: int, roles: Roles = PANEL) -> DataFrame:
    """(_id, _name, _platform, date, p10, p50, p90) of all days, every campaign rolled within its task."""
    spark, have = state.sparkSession, state.columns
    dates = [last_day + dt.timedelta(days=i + 1) for i in range(n_days)]
    parts = {c: e.cast("double").alias(c) for c, e in calendar_parts("date").items() if c in have}
    # One row per future day.
    calendar = [(r.date, r.asDict()) for r in spark.createDataFrame([(d,) for d in dates], "date date").select("date", *parts.values()).collect()]
    measures = [c for c in have if c in {*model.numeric, *[f"spend_lag_{w}" for w in ROAS_LAGS]}]
    named = {"_id": roles.entity, "_name": roles.name, "_platform": roles.platform}
    keys = [F.col(c).alias(k) if c in have else (F.col(roles.entity).cast("string") if k == "_name" else F.lit("")).alias(k)
            for k, c in named.items()]
    # Columns may not carry the name under which the bins of the categories come back.
    rows = model.coded(state.select(*keys, "_buf", *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(measures)], *model.categorical))
    rows = rows.select(*named, "_buf", "c", *[f"_x{i}" for i in range(len(measures))])
    shared = spark.sparkContext.broadcast(model.detached())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            buf = batch.column("_buf").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, BUFFER_DAYS)
            codes = batch.column("c").flatten().to_numpy(zero_copy_only=False).reshape(n, len(forest.categorical))
            still = {c: batch.column(f"_x{i}").to_numpy(zero_copy_only=False).astype(float) for i, c in enumerate(measures)}
            for day, numbers in calendar:
                found = still | {c: np.full(n, v) for c, v in numbers.items() if c != "date"} | revenue_arrays(buf, have)
                found |= _derived(found, have)
                values = np.stack([found[c] for c in forest.numeric], axis=1) if forest.numeric else np.zeros((n, 0))
                low, middle, high = forest.quantiles(values, codes).T
                p50 = np.maximum(middle, 0.0)
                columns = [*[batch.column(k) for k in named], pa.array([day] * n, pa.date32()),
                           *map(pa.array, (np.maximum(np.minimum(low, middle), 0.0), p50, np.maximum(np.maximum(high, middle), 0.0)))]
                yield pa.RecordBatch.from_arrays(columns, [*named, "date", "p10", "p50", "p90"])
                buf = np.concatenate([buf[:, 1:], p50[:, None]], axis=1)

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in named)
    return rows.mapInArrow(run, f"{kinds}, date date, p10 double, p50 double, p90 double")


def _on_arrays(model) -> bool:
    """Whether tasks can evaluate the model; categories must not change from day to day."""
    offers = all(hasattr(model, name) for name in ("coded", "detached", "quantiles", "numeric", "categorical"))
    return offers and not set(model.categorical) & set(calendar_parts("date"))


def _step(state: DataFrame, day: dt.date) -> DataFrame:
    """Feature rows of one future day; spend and the other measures stay at their last value."""
    have = state.columns
    out = state.withColumn("date", F.lit(day))
    out = out.withColumns({c: e for c, e in calendar_parts("date").items() if c in have})
    out = out.withColumns(revenue_features("_buf", have))
    derived = {
        f"revenue_momentum_{w}": ratio("revenue_lag_1", f"revenue_roll_mean_{w}")
        for w in MOMENTUM_SPEC["revenue"] if f"revenue_roll_mean_{w}" in have and "revenue_lag_1" in have
    }
    derived |= {
        f"roas_lag_{w}": ratio(f"revenue_lag_{w}", f"spend_lag_{w}")
        for w in ROAS_LAGS if f"revenue_lag_{w}" in have and f"spend_lag_{w}" in have
    }
    derived = {c: e for c, e in derived.items() if c in have}
    return out.withColumns(derived) if derived else out


def carried(fs: DataFrame, model, roles: Roles = PANEL) -> DataFrame:
    """The columns a step needs: keys, revenue, the model's inputs, and what those are derived from."""
    features = getattr(model, "features", None)
    if features is None:
        return fs
    wanted = {roles.entity, roles.name, roles.platform, roles.date, roles.revenue, *features}
    wanted |= {f"{kind}_lag_{w}" for w in ROAS_LAGS if f"roas_lag_{w}" in features for kind in ("revenue", "spend")}
    for w in MOMENTUM_SPEC["revenue"]:
        if f"revenue_momentum_{w}" in features:
            wanted |= {"revenue_lag_1", f"revenue_roll_mean_{w}"}
    return fs.select(*[c for c in fs.columns if c in wanted])


def _schema(fs: DataFrame, roles: Roles) -> T.StructType:
    text, number = T.StringType(), T.DoubleType()
    kinds = {"date": T.DateType(), "campaign_id": fs.schema[roles.entity].dataType, "campaign_name": text, "platform": text,
             "is_future": T.BooleanType()}
    return T.StructType([T.StructField(c, kinds.get(c, number)) for c in FORECAST_COLUMNS])


def score_portfolio(fs: DataFrame, model, days: int = 30, n_days: int = 14) -> DataFrame:
    """The scoring path: the last ``days`` of mature rows, then ``n_days`` ahead, as one checked forecast table."""
    out = cut_lineage(union_future(score_recent(fs, model, days), forecast_rollout(fs, model, n_days)))
    found = forecast_violations(out).first()
    if found["n_crossings"] or found["n_negative_p50"]:
        raise QualityError(f"forecast: {found['n_crossings']} crossings, {found['n_negative_p50']} negative P50")
    return out


def forecast_rollout(
    fs: DataFrame,
    model,
    n_days: int = 14,
    active_within_days: int | None = None,
    roles: Roles = PANEL,
) -> DataFrame:
    """campaigns x days forecast rows after the last day of the whole feature store.

    ``model`` is anything with ``predict(df) -> df + p10, p50, p90``; if it names its ``features``, no
    other measures are carried from day to day.  Campaigns that stopped early also roll from the
    global last day; ``active_within_days`` leaves them out.  No days or an empty store give no rows.
    A model with ``coded``, ``detached`` and ``quantiles`` takes all days in one stage, others a stored table a day.
    """
    last_day = fs.agg(F.max(roles.date)).first()[0] if n_days > 0 else None
    if last_day is None:
        return fs.sparkSession.createDataFrame([], _schema(fs, roles))
    state = rollout_state(carried(fs, model, roles), last_day, roles)
    if active_within_days is not None:
        state = state.filter(F.col(roles.date) > F.lit(last_day - dt.timedelta(days=active_within_days)))
    if _on_arrays(model):
        return cut_lineage(rolled(state, model, last_day, n_days, roles)).select(
            "date", F.col("_id").alias("campaign_id"), F.col("_name").alias("campaign_name"), F.col("_platform").alias("platform"),
            F.lit(None).cast("double").alias("revenue_attributed"), "p10", "p50", "p90", F.lit(True).alias("is_future"))
    state = cut_lineage(state)
    keep, out = state.columns, None
    for offset in range(1, n_days + 1):
        day = last_day + dt.timedelta(days=offset)
        scored = model.predict(_step(state, day))
        pushed = F.slice(F.concat(F.col("_buf"), F.array(F.col("p50"))), 2, BUFFER_DAYS)
        scored = cut_lineage(scored.withColumn("_buf", pushed))
        rows = scored.select(
            F.lit(day).alias("date"), F.col(roles.entity).alias("campaign_id"),
            F.col(roles.name).alias("campaign_name") if roles.name in keep
            else F.col(roles.entity).cast("string").alias("campaign_name"),
            F.col(roles.platform).alias("platform") if roles.platform in keep else F.lit("").alias("platform"),
            F.lit(None).cast("double").alias("revenue_attributed"),
            "p10", "p50", "p90", F.lit(True).alias("is_future"),
        ).select(*FORECAST_COLUMNS)
        out = rows if out is None else out.unionByName(rows)
        state = scored.select(*keep)
    return out

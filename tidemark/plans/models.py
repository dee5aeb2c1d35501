"""Queries without an SQL twin: trained forecasts, rollout, budget allocation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import in_last, last_date
from tidemark.functions.metrics import METRIC_NAMES
from tidemark.operators import allocate as A
from tidemark.operators import backtest as B
from tidemark.operators import context as X
from tidemark.operators import insights as I
from tidemark.operators import recommend as N
from tidemark.operators import reports as R
from tidemark.operators import response as P
from tidemark.operators import risks as K
from tidemark.operators import rollout as O
from tidemark.operators.forest import ForestConfig, Glance, fit_quantile_forest
from tidemark.operators.series import mature_rows
from tidemark.plans import tables as V
from tidemark.plans.features import feature_table
from tidemark.plans.registry import query
from tidemark.session import cut_lineage


def feature_rows(spark, d, keep=None):
    """Feature store of the stored facts, computed by every pass that reads it: as a table it takes some twenty times their disk."""
    return feature_table(spark, d, V.stored_facts(spark, d), keep)


def store(spark, d):
    """``feature_rows`` with what a backtest lays out its bins and folds by, so that all features are computed once."""
    fs = feature_rows(spark, d)
    fs.glance = glance(spark, d, V.stored_facts(spark, d))
    return fs


def glance(spark, d, rows):
    """``rows`` of the facts and the feature rows, as many as a forest takes its bin edges from, drawn by a hash of their keys."""
    share = min(1.0, ForestConfig.edge_rows / max(1, rows.count()))
    drawn = F.pmod(F.xxhash64("campaign_id", "date"), F.lit(1_000_000)) < int(share * 1_000_000)
    return Glance(rows, feature_rows(spark, d, drawn & F.col("attribution_mature")))


def forest(spark, d):
    """The quantile forest of all mature rows."""
    return fit_quantile_forest(mature_rows(feature_rows(spark, d)), glance=glance(spark, d, mature_rows(V.stored_facts(spark, d))))


def recent_rows(spark, d, days=30):
    """Feature rows of the last ``days`` of mature facts."""
    mature = mature_rows(V.stored_facts(spark, d))
    return cut_lineage(feature_rows(spark, d, F.col("attribution_mature") & in_last("date", last_date(mature), days)))


def latest_rows(spark, d, days=O.BUFFER_DAYS):
    """Feature rows that a rollout looks at: the last of every campaign, and those of the last ``days``."""
    facts = V.stored_facts(spark, d)
    last = F.lead(F.lit(1)).over(Window.partitionBy("campaign_id").orderBy("date")).isNull()
    return cut_lineage(feature_rows(spark, d, last | in_last("date", last_date(facts), days)))


_FORECAST_KEYS = ["date", "campaign_id", "campaign_name", "platform", "is_future"]


@query("quantile_forecast", _FORECAST_KEYS, ["revenue_attributed", "p10", "p50", "p90"])
def quantile_forecast(spark, d):
    return B.score_recent(recent_rows(spark, d), forest(spark, d))


@query("feature_importance", ["feature"], ["p10_imp", "p50_imp", "p90_imp", "mean_imp"])
def feature_importance(spark, d):
    return forest(spark, d).importance(spark)


@query("backtest", ["fold_id", "train_start", "train_end", "val_start", "val_end", "n_train", "n_val_mature"], METRIC_NAMES)
def backtest(spark, d):
    return B.backtest(store(spark, d), config=ForestConfig())


@query("forecast_rollout", _FORECAST_KEYS, ["p10", "p50", "p90"])
def forecast_rollout(spark, d):
    return O.forecast_rollout(latest_rows(spark, d), forest(spark, d), n_days=14)


def _allocation(spark, d, rows=None):
    curves = cut_lineage(P.response_curves(V.stored_facts(spark, d) if rows is None else rows))
    return curves, A.allocate_budget(curves)


_ALLOCATION_DOUBLES = ["baseline_spend", "optimal_spend", "spend_delta", "spend_delta_pct", "baseline_revenue",
                       "optimal_revenue", "revenue_delta", "revenue_delta_pct", "baseline_marginal_roas",
                       "optimal_marginal_roas", "saturation_at_optimal"]


@query("allocate_budget", ["campaign_id", "campaign_name", "platform"], _ALLOCATION_DOUBLES)
def allocate_budget(spark, d):
    return _allocation(spark, d)[1].table


@query("allocation_summary", ["converged", "n_iterations", "solver_message"],
       ["total_budget", "baseline_total_revenue", "optimal_total_revenue", "revenue_lift", "revenue_lift_pct",
        "baseline_roas", "optimal_roas", "risk_score", "budget_allocated", "budget_error"])
def allocation_summary(spark, d):
    return _allocation(spark, d)[1].summary


@query("allocation_display", ["campaign_id", "platform"],
       ["current_spend", "optimal_spend", "spend_change", "spend_change_pct", "revenue_lift", "saturation"])
def allocation_display(spark, d):
    return R.allocation_display(_allocation(spark, d)[1].table)


@query("recommendations", ["type", "priority", "title", "rationale", "source_campaign_id", "target_campaign_id"],
       ["expected_revenue_lift", "expected_revenue_lift_pct", "spend_change"])
def recommendations(spark, d):
    return N.recommendations(_allocation(spark, d)[1].table)


#: Days before the last one that any part of the document looks at: two periods of seven, and the risks' thirty.
_FORECAST_DAYS, _FACT_DAYS = 14, 30


def _context_windows(rows, fc):
    """Forecasts and facts that the document looks at, cut once instead of by each of its dozen readers."""
    end = last_date(rows)
    return fc.filter(in_last("date", end, _FORECAST_DAYS)), rows.filter(in_last("date", end, _FACT_DAYS))


@query("context_json", ["context"])
def context_json(spark, d):
    """The whole portfolio as one document."""
    rows = V.stored_facts(spark, d)
    fc, recent = (cut_lineage(t) for t in _context_windows(rows, V.forecast(spark, d, rows)))
    curves, allocation = _allocation(spark, d, rows)
    summary = X.context_summary(fc, curves, allocation.summary)
    return X.context_json(summary, I.all_insights(fc, recent), K.all_risks(recent, curves, fc),
                          N.recommendations(allocation.table), X.campaign_buckets(curves))

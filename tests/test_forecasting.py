import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest as B
from tidemark.operators import features as O
from tidemark.operators import rollout as R
from tidemark.operators import insights as I
from tidemark.operators.forest import ForestConfig, QuantileForest, feature_columns, fit_quantile_forest, history_columns
from tidemark.operators.quantiles import SegmentQuantiles
from tidemark.roles import ROLLING_SPEC, lag_columns, rolling_columns

SMALL = ForestConfig(trees=4, depth=4)
START = dt.date(2024, 1, 1)


class LastDayPlus:
    """Stub model: yesterday's revenue plus one."""

    def predict(self, df):
        p50 = F.coalesce(F.col("revenue_lag_1"), F.lit(0.0)) + 1.0
        return df.withColumns({"p10": p50 * 0.8, "p50": p50, "p90": p50 * 1.2})


@pytest.fixture(scope="module")
def store(spark):
    rng = np.random.default_rng(0)
    rows = []
    for c in range(3):
        for i in range(120):
            if c == 2 and i % 5 == 3:
                continue
            rows.append(("google", c, f"Search_TM_Campaign_{c}", START + dt.timedelta(days=i), 10.0 + c + i % 7,
                         float(c * 50 + i + rng.normal(0, 5) + 100), 1.0, 2.0, None, 100.0, "Search", None, None, i < 106))
    schema = ("platform string, campaign_id bigint, campaign_name string, date date, spend double, "
              "revenue_attributed double, clicks double, impressions double, conversions double, daily_budget double, "
              "channel_format string, reach double, video_views double, attribution_mature boolean")
    return O.build_feature_store(spark.createDataFrame(rows, schema)).cache()


def test_rollout_shape_and_feedback(store):
    out = R.forecast_rollout(store, LastDayPlus(), n_days=5).collect()
    assert len(out) == 15 and all(r.is_future and r.revenue_attributed is None for r in out)
    last = {r.campaign_id: r.revenue_attributed for r in store.filter("date = DATE '2024-04-29'").collect()}
    by = {(r.campaign_id, r.date): r.p50 for r in out}
    for c in last:
        for n in range(1, 6):
            assert by[c, dt.date(2024, 4, 29) + dt.timedelta(days=n)] == pytest.approx(last[c] + n)


def test_rollout_features_equal_day_windows(store, spark):
    """The array form of the rollout and the range windows are two roads to the same numbers."""
    last = dt.date(2024, 4, 29)
    state = R.rollout_state(store, last)
    names = [c for c in lag_columns() + rolling_columns() if c.startswith("revenue")]
    got = {r.campaign_id: r for r in state.select("campaign_id", *[
        e.alias(n) for n, e in R.revenue_features("_buf", names).items()]).collect()}
    base = store.select("campaign_id", "date", "revenue_attributed")
    tomorrow = base.select("campaign_id").distinct().select(
        "campaign_id", F.lit(last + dt.timedelta(days=1)).alias("date"), F.lit(None).cast("double").alias("revenue_attributed"))
    spec = {"revenue_attributed": (1, 3, 7, 14, 28)}
    rolls = {"revenue_attributed": ROLLING_SPEC["revenue_attributed"]}
    rows = O.rolling_features(O.lag_features(base.unionByName(tomorrow), spec, mode="days"), rolls, mode="days")
    for r in rows.filter(F.col("date") > F.lit(last)).collect():
        for n in names:
            assert got[r.campaign_id][n] == (pytest.approx(r[n]) if r[n] is not None else None), n


def test_rollout_active_filter_and_errors(store):
    stopped = store.filter("campaign_id <> 1 OR date < DATE '2024-03-01'")
    assert R.forecast_rollout(stopped, LastDayPlus(), n_days=1).count() == 3
    assert R.forecast_rollout(stopped, LastDayPlus(), n_days=1, active_within_days=30).count() == 2
    for none in (R.forecast_rollout(store, LastDayPlus(), n_days=0), R.forecast_rollout(store.filter("false"), LastDayPlus())):
        assert none.columns == R.FORECAST_COLUMNS and none.count() == 0


class DayByDay:
    """A forest that hides its arrays, so that the rollout applies it day by day."""

    def __init__(self, forest):
        self.features, self.predict = forest.features, forest.predict


def test_rollout_in_one_stage_equals_day_by_day(store):
    """The forest on arrays and as a projection: the same rows, gaps and stopped campaigns included."""
    rows = store.filter("campaign_id <> 1 OR date < DATE '2024-03-20'")
    model = fit_quantile_forest(rows.filter("attribution_mature"), config=SMALL)
    fast = R.forecast_rollout(rows, model, n_days=14)
    slow = R.forecast_rollout(rows, DayByDay(model), n_days=14)
    assert fast.dtypes == slow.dtypes and fast.columns == R.FORECAST_COLUMNS
    assert sorted(map(tuple, fast.collect()), key=repr) == sorted(map(tuple, slow.collect()), key=repr)
    assert fast.count() == 3 * 14
    assert R.forecast_rollout(rows, model, n_days=2, active_within_days=14).count() == 2 * 2


@pytest.fixture(scope="module")
def model(store):
    return fit_quantile_forest(store.filter("attribution_mature"), config=SMALL)


def test_forest_orders_quantiles_and_survives_new_categories(store, model):
    odd = store.withColumn("strategy_key", F.lit("never seen")).withColumn("spend", F.lit(None).cast("double"))
    for r in model.predict(odd).collect():
        assert 0 <= r.p10 <= r.p50 <= r.p90
    assert len(feature_columns(store)) == 86 and len(history_columns(store)) == 78


def test_forest_learns_and_covers(store, model):
    train = model.predict(store.filter("attribution_mature")).select(
        F.avg(F.abs(F.col("p50") - F.col("revenue_attributed"))),
        F.avg(F.col("revenue_attributed").between(F.col("p10"), F.col("p90")).cast("double"))).first()
    assert train[0] < 20 and train[1] > 0.6


def test_forest_round_trip_and_importance(store, model, spark, tmp_path):
    model.save(str(tmp_path / "m"))
    again = QuantileForest.load(str(tmp_path / "m"))
    few = store.filter("date = DATE '2024-04-01'").orderBy("campaign_id")
    assert [r.p50 for r in again.predict(few).collect()] == [r.p50 for r in model.predict(few).collect()]
    imp = model.importance(spark).collect()
    assert len(imp) == 86
    for column in ("p10_imp", "p50_imp", "p90_imp", "mean_imp"):
        assert sum(r[column] for r in imp) == pytest.approx(1.0)
    assert any(r.p10_imp != r.p90_imp for r in imp)


def test_forest_beats_quantiles_out_of_sample(spark):
    """On later days than it was fitted on, over series with a weekly rhythm, level shifts and noise."""
    rng = np.random.default_rng(3)
    rows = []
    for c in range(12):
        level = rng.uniform(100, 1000)
        for i in range(300):
            level = max(20.0, level * float(rng.normal(1.0, 0.03)))
            revenue = max(0.0, level * (1.0 + 0.4 * (i % 7 >= 5)) + float(rng.normal(0, 0.15 * level)))
            rows.append(("google" if c % 2 else "bing", c, f"Search_TM_Campaign_{c}", START + dt.timedelta(days=i), 50.0, revenue,
                         1.0, 2.0, None, 100.0, "Search", None, None, True))
    schema = ("platform string, campaign_id bigint, campaign_name string, date date, spend double, "
              "revenue_attributed double, clicks double, impressions double, conversions double, daily_budget double, "
              "channel_format string, reach double, video_views double, attribution_mature boolean")
    fs = O.build_feature_store(spark.createDataFrame(rows, schema)).cache()
    folds = {"min_train": 240, "val": 30, "step": 30}
    by = ["platform", "day_of_week"]
    forest = B.backtest(fs, config=ForestConfig(), **folds).first()
    plain = B.backtest(fs, fit=lambda rows: SegmentQuantiles.fit(rows, by), **folds).first()
    for metric in ("pinball_p10", "pinball_p50", "pinball_p90"):
        assert forest[metric] < plain[metric], metric
    assert 0.65 <= forest["coverage_80"] <= 0.95


def test_train_from_exports_and_from_a_store(spark, store, tmp_path):
    store.write.parquet(str(tmp_path / "store"))
    assert B.load_store(spark, str(tmp_path / "store")).count() == store.count()
    with pytest.raises(Exception):
        B.load_store(spark, str(tmp_path / "nothing"))


def test_train_writes_model_and_report(store, spark, tmp_path):
    got = B.train(store, str(tmp_path / "model"), str(tmp_path / "report"), config=SMALL,
                  min_train=60, val=20, step=20, max_folds=2)
    assert got.fold_metrics.count() == 2
    report = json.loads(spark.read.text(str(tmp_path / "report")).first()[0])
    assert report["n_folds"] == 2 and report["n_features"] == 86 and len(report["fold_metrics"]) == 2
    assert report["aggregated_metrics"]["mean_mae_p50"] > 0
    recent = B.score_recent(store, got.model, 7)
    assert recent.agg(F.max("date")).first()[0] == START + dt.timedelta(days=105)


def test_insights_on_a_growing_forecast(spark):
    rows = [(START + dt.timedelta(days=i), c, "google" if c < 2 else "bing", 80.0 + i * 10, 100.0 + i * (10 if c < 2 else 1), 190.0 + i * 30)
            for i in range(14) for c in range(4)]
    fc = spark.createDataFrame(rows, "date date, campaign_id bigint, platform string, p10 double, p50 double, p90 double")
    out = I.all_insights(fc).collect()
    kinds = [r.type for r in out]
    assert {"revenue_trend", "platform_share", "forecast_confidence", "top_campaign"} <= set(kinds)
    assert [r.severity for r in out] == sorted((r.severity for r in out), key=I.SEVERITIES.index)
    trend = next(r for r in out if r.type == "revenue_trend")
    assert trend.severity == "positive" and trend.title.startswith("Revenue trending up ")
    days = spark.createDataFrame([(START + dt.timedelta(days=i), 0.5) for i in range(20)],
                                 "date date, holiday_intensity_score double")
    assert I.holiday_signal(days).first().title == "Elevated holiday intensity detected (score=0.50)"

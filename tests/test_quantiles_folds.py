import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.errors import FoldError
from tidemark.operators import folds as B
from tidemark.operators import quantiles as Q


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    groups = {
        "smooth": rng.normal(0, 1e4, 4001),            # both signs
        "ties": np.repeat([0.0, 5.0, 7.5], [900, 50, 50]),
        "money": np.round(rng.gamma(2, 500, 3000), 2),
        "one": np.array([3.25]),
        "tiny": np.array([-1e-9, 0.0, 1e-9, 1e9]),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("money", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r.g: r for r in Q.exact_quantiles(df, ["g"], "v", probs).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-15)


def test_crowded_bins_are_cut_again(spark, monkeypatch):
    """A million distinct values inside one bin: no window gets more of them than a bin may hold."""
    monkeypatch.setattr(Q, "CROWDED", 2_000)
    n = 1_000_000
    values = spark.range(n).select(F.lit("g").alias("g"), (F.lit(1000.0) + F.col("id") / F.lit(n)).alias("v"))
    few = spark.createDataFrame([("h", 1.0 + 1e-13 * i) for i in range(5000)] + [("h", 7.0)] * 50, "g string, v double")
    df = values.unionByName(few)
    assert df.filter("g = 'g'").select(Q._bin(F.col("v")).alias("b")).distinct().count() == 1
    probs = {"a": 0.1, "b": 0.5, "c": 0.9731}
    got = {r.g: r for r in Q.exact_quantiles(df, ["g"], "v", probs).collect()}
    for g, vs in (("g", 1000.0 + np.arange(n) / n), ("h", np.array([1.0 + 1e-13 * i for i in range(5000)] + [7.0] * 50))):
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(vs, p), rel=1e-14)


@pytest.mark.parametrize("crowded", [50_000, 10])
def test_prefix_quantiles_match_numpy(spark, monkeypatch, crowded):
    """Quantiles of every prefix from one set of counts, with empty prefixes, ties and rows that no prefix holds."""
    monkeypatch.setattr(Q, "CROWDED", crowded)
    rng = np.random.default_rng(4)
    rows = [(g, int(k), float(v)) for g, low in (("a", 0), ("b", 3)) for k, v in zip(
        rng.integers(low, 8, 600), np.round(rng.normal(0, 3, 600), 1))] + [("a", 2, None)]
    df = spark.createDataFrame(rows, "g string, k int, v double")
    probs = {"lo": 0.1, "mid": 0.5, "hi": 0.95}
    got = {(r.g, r.step): r for r in Q.prefix_quantiles(df, ["g"], "v", probs, "k", 6, "step").collect()}
    assert set(got) == {("a", s) for s in range(6)} | {("b", s) for s in range(3, 6)}
    for (g, s), r in got.items():
        held = [v for x, k, v in rows if x == g and k <= s and v is not None]
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.quantile(held, p), rel=1e-12)


def test_first_training_folds(panel):
    folds = B.rolling_origin_folds(panel, min_train=90)
    first = B.first_training_folds(panel, folds).groupBy("first_fold").count()
    starts = [f.val_start for f in folds.orderBy("fold_id").collect()]
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(300)]
    want = {}
    for d in days:
        held = [i for i, s in enumerate(starts) if d < s]
        if held:
            want[held[0]] = want.get(held[0], 0) + 3
    assert {r.first_fold: r["count"] for r in first.collect()} == want


def test_repair(spark):
    df = spark.createDataFrame([(5.0, 3.0, 1.0), (-4.0, -2.0, -1.0), (1.0, 2.0, 3.0)], "p10 double, p50 double, p90 double")
    assert [tuple(r) for r in Q.repair_quantiles(df).collect()] == [(3, 3, 3), (0, 0, 0), (1, 2, 3)]


@pytest.fixture(scope="module")
def panel(spark):
    day = F.expr("date_add(DATE '2024-01-01', CAST(id % 300 AS INT))")
    return spark.range(900).select(
        (F.col("id") / 300).cast("int").alias("campaign_id"), day.alias("date"),
        (F.col("id") % 300 < 286).alias("attribution_mature"), F.col("id").cast("double").alias("revenue_attributed"))


def test_fold_bounds_and_counts(panel):
    folds = B.rolling_origin_folds(panel, min_train=90).orderBy("fold_id").collect()
    assert [f.fold_id for f in folds] == list(range(7))
    assert folds[0].val_start == dt.date(2024, 1, 1) + dt.timedelta(days=90)
    assert all(f.n_val == 90 and f.val_days == 30 for f in folds)
    assert [f.n_train for f in folds] == [3 * (90 + 30 * i) for i in range(7)]
    assert all(f.train_end < f.val_start for f in folds)
    assert B.rolling_origin_folds(panel, min_train=90, max_folds=2).count() == 2
    assert B.leakage_violations(B.rolling_origin_folds(panel, min_train=90)).isEmpty()


def test_empty_folds_are_skipped_and_ids_stay_dense(panel):
    hole = panel.filter("date < DATE '2024-04-25' OR date > DATE '2024-06-05'")
    folds = B.rolling_origin_folds(hole, min_train=90).orderBy("fold_id").collect()
    assert [f.fold_id for f in folds] == list(range(len(folds))) and len(folds) == 6


def test_fold_errors(panel):
    with pytest.raises(ValueError):
        B.rolling_origin_folds(panel, step=0)
    with pytest.raises(FoldError):
        B.rolling_origin_folds(panel, min_train=290, strict=True)


def test_metrics(spark):
    df = spark.createDataFrame([(0, 10.0, 8.0, 12.0, 15.0), (0, 0.0, 1.0, 2.0, 3.0)],
                               "fold_id int, revenue_attributed double, p10 double, p50 double, p90 double")
    m = B.fold_metrics(df).first()
    assert m.mae_p50 == 2.0 and m.rmse_p50 == 2.0 and m.coverage_80 == 0.5
    assert m.mape_p50 == pytest.approx((2 / 11 + 2 / 1) / 2 * 100)
    assert m.smape_p50 == pytest.approx((2 / 12 + 2 / 2) / 2 * 100)
    assert m.pinball_p10 == pytest.approx((0.1 * 2 + 0.9 * 1) / 2)
    assert m.pinball_p90 == pytest.approx((0.1 * 5 + 0.1 * 3) / 2)
    assert B.metric_summary(B.fold_metrics(df)).first().std_mae_p50 == 0.0

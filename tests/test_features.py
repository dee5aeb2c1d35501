import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.errors import PanelError, QualityError
from tidemark.operators import features as O
from tidemark.operators import series as S
from tidemark.operators.quality import enforce, feature_store_violations
from tidemark.roles import NON_FEATURES, lag_columns, momentum_columns, rolling_columns
from tidemark.functions.exprs import feature_names


@pytest.fixture(scope="module")
def store(two_campaigns):
    df = O.build_feature_store(two_campaigns, check=True).cache()
    rows = {(r.campaign_id, (r.date - dt.date(2024, 1, 1)).days): r for r in df.collect()}
    return df, rows


def test_manifest(store):
    df, rows = store
    assert len(df.columns) == 92 and len(feature_names(df, NON_FEATURES)) == 86
    assert len(lag_columns()) == 22 and len(rolling_columns()) == 20 and len(momentum_columns()) == 6
    assert len(rows) == 70


def test_closed_form_lags_and_windows(store):
    _, r = store
    a = "camp_A"
    assert r[a, 1].revenue_lag_1 == 100 and r[a, 10].revenue_lag_7 == 400
    assert r[a, 20].revenue_lag_14 == 700 and r[a, 28].revenue_lag_28 == 100
    assert [r[a, i].revenue_roll_mean_7 for i in (7, 8, 10)] == [400, 500, 700]
    assert r[a, 14].revenue_roll_mean_14 == 750 and r[a, 28].revenue_roll_mean_28 == 1450
    assert r[a, 14].revenue_roll_min_7 == 800 and r[a, 14].revenue_roll_max_7 == 1400
    assert r[a, 1].revenue_roll_std_7 is None and r[a, 2].revenue_roll_std_7 == pytest.approx(70.71067811)
    assert all(r[a, 0][c] is None for c in lag_columns() + rolling_columns() + momentum_columns())
    assert r[a, 10].revenue_momentum_7 == pytest.approx(1000 / 700)
    assert r[a, 10].roas_lag_7 == pytest.approx(10.0)


def test_campaigns_do_not_bleed_and_today_never_counts(store):
    _, r = store
    assert r["camp_B", 0].revenue_lag_1 is None
    for i in range(1, 35):
        for cid in ("camp_A", "camp_B"):
            assert r[cid, i].revenue_roll_max_7 < r[cid, i].revenue_attributed
            assert r[cid, i].revenue_lag_1 < r[cid, i].revenue_attributed


def test_row_level_features(store):
    _, r = store
    x = r["camp_A", 5]
    assert x.day_of_week == 5 and x.is_weekend and x.month == 1 and x.week_of_year == 1 and x.quarter == 1
    assert x.budget_utilization == pytest.approx(60 / 500) and x.budget_headroom == 440
    assert r["camp_A", 0].is_holiday and x.strategy_key == "google_camp_A"


def test_days_mode_respects_gaps(spark, two_campaigns):
    gap = two_campaigns.filter("campaign_id = 'camp_A' AND date <> DATE '2024-01-05'")
    by_row = {x.date.day: x for x in O.lag_features(gap, {"spend": (1,)}).filter("date < DATE '2024-01-20'").collect()}
    by_day = {x.date.day: x for x in O.lag_features(gap, {"spend": (1,)}, mode="days")
              .filter("date < DATE '2024-01-20'").collect()}
    assert by_row[6].spend_lag_1 == 40 and by_day[6].spend_lag_1 is None and by_day[7].spend_lag_1 == 60


def test_zero_denominators_are_null(two_campaigns):
    flat = two_campaigns.withColumn("spend", F.lit(0.0)).withColumn("daily_budget", F.lit(0.0))
    df = O.momentum(O.rolling_features(O.lag_features(flat)))
    df = O.roas_lags(O.budget_features(df))
    row = df.agg(*[F.count(c).alias(c) for c in ("spend_momentum_7", "roas_lag_7", "budget_utilization")]).first()
    assert tuple(row) == (0, 0, 0)


def test_custom_spec_missing_columns_and_grain(two_campaigns):
    assert "reach_lag_2" in O.lag_features(two_campaigns, {"reach": (2,)}).columns
    with pytest.raises(PanelError, match="missing"):
        O.lag_features(two_campaigns.drop("clicks"))
    with pytest.raises(PanelError, match="missing"):
        O.momentum(two_campaigns)
    store = O.build_feature_store(two_campaigns.unionByName(two_campaigns.limit(1)))
    with pytest.raises(QualityError, match="duplicate_grain"):
        enforce(feature_store_violations(store), store)


def test_recent_rows(two_campaigns):
    assert S.trailing_rows(two_campaigns, 3).count() == 6
    assert {r.date for r in S.latest_rows(two_campaigns).collect()} == {dt.date(2024, 2, 4)}
    assert S.trailing_days(two_campaigns, 7).count() == 14 and S.prior_days(two_campaigns, 7).count() == 14
    change = S.period_over_period(two_campaigns, "revenue_attributed", 7).first()
    assert change.recent == 3 * sum(range(2900, 3600, 100)) and change.n_prior == 14
    assert S.select_campaigns(two_campaigns, campaigns=["camp_A"]).count() == 35


def test_taxonomy_join_needs_both_keys(spark, two_campaigns):
    from tidemark.operators.taxonomy import parse_taxonomy

    dim = parse_taxonomy(two_campaigns)
    swapped = dim.withColumn("platform", F.lit("bing")).withColumn("format", F.lit("wrong"))
    got = O.join_taxonomy(two_campaigns, dim.unionByName(swapped).unionByName(dim))
    assert got.count() == 70 and got.filter("format = 'wrong'").isEmpty()
    assert got.filter("strategy_key IS NULL").isEmpty()
    assert O.join_taxonomy(two_campaigns, swapped).filter("strategy_key IS NOT NULL").isEmpty()

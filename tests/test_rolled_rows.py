"""The store's lags and windows equal Spark's own frames, bit by bit, and cost one shuffle by campaign."""

import datetime as dt
import random

from tidemark.operators import features as O
from tidemark.roles import lag_columns, rolling_columns


def panel(spark):
    draw = random.Random(7)
    rows = []
    for cid in [*map(str, range(40)), None]:
        for day in sorted(draw.sample(range(400), draw.choice([1, 2, 5, 29, 300]))):
            x = [None if draw.random() < 0.2 else draw.choice([float("nan"), 0.0, -0.0]) if draw.random() < 0.05 else draw.uniform(0, 1e4) for _ in range(5)]
            rows.append((cid, dt.date(2024, 1, 1) + dt.timedelta(days=day), *x))
    return spark.createDataFrame(rows, "campaign_id string, date date, revenue_attributed double, spend double, clicks double, impressions double, conversions double")


def test_lagged_and_rolled_equal_the_frames(spark, monkeypatch):
    rows, keys = panel(spark), ["campaign_id", "date"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        names = [*keys, *lag_columns(), *rolling_columns()]
        fast = O.lagged_and_rolled(rows).select(names)
        plain = O.rolling_features(O.lag_features(rows)).select(names)
        assert fast.count() == rows.count()
        assert fast.exceptAll(plain).count() == plain.exceptAll(fast).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_wide_rows_are_not_dealt_out_again(two_campaigns):
    plan = O.build_feature_store(two_campaigns.repartition("campaign_id"))._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("MapInArrow")]
    assert "hashpartitioning" not in above.split("== Initial Plan ==")[-1]

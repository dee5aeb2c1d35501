"""The fit cuts the campaigns out of sorted partitions: wherever a batch ends, a campaign is fitted on all its rows."""

import re

import numpy as np
import pytest

from tidemark.operators import response as P

SCHEMA = "campaign_id {}, spend double, revenue_attributed double"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    return [(c, float(s), float(900 * s / (s + 40 * c) * rng.uniform(0.8, 1.2))) for c in range(1, 12) for s in rng.uniform(5, 900, 5 + 9 * c)]


def fitted(df):
    keys = ["v_max", "k", "n", "r_squared"]
    return {str(r.campaign_id): (r.fit_reason, *[pytest.approx(r[k], rel=1e-9) for k in keys]) for r in P.fit_hill(df).collect()}


def test_batches_may_end_anywhere(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA.format("bigint")).repartition(3)
    whole = fitted(df)
    assert len(whole) == 11
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        assert fitted(df) == whole
        assert fitted(df.selectExpr("cast(campaign_id as string) campaign_id", "spend", "revenue_attributed")) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_no_group_of_its_own_per_campaign(spark, rows):
    plan = P.fit_hill(spark.createDataFrame(rows, SCHEMA.format("bigint")))._jdf.queryExecution().executedPlan().toString()
    assert re.search("MapInArrow", plan, re.I) and "FlatMapGroups" not in plan

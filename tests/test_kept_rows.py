"""Feature rows are computed for the rows that are wanted, and the wide table is never stored by the queries that train on it."""

import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.test_rolled_rows import panel
from tidemark import session
from tidemark.operators import features as O
from tidemark.plans import models
from tidemark.plans import tables as V
from tidemark.roles import lag_columns, rolling_columns

DATA = "/root/testdata/sf0.001"


def test_kept_rows_look_back_on_all(spark):
    """A hash of the keys, and the last row of every campaign: the same values as among all rows, in batches of any size."""
    rows, names = panel(spark), ["campaign_id", "date", *lag_columns(), *rolling_columns()]
    last = F.lead(F.lit(1)).over(Window.partitionBy("campaign_id").orderBy("date")).isNull()
    drawn = F.when(F.col("campaign_id") != "7", F.pmod(F.xxhash64("campaign_id", "date"), F.lit(9)) == 0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        for keep in (last, drawn, last | drawn, F.lit(False)):
            want = O.lagged_and_rolled(rows.withColumn("_wanted", F.coalesce(keep, F.lit(False)))).filter("_wanted").select(names)
            got = O.lagged_and_rolled(rows, keep=keep).select(names)
            assert got.count() == want.count() and got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not present")
def test_feature_rows_are_not_stored(spark, tmp_path, monkeypatch):
    V.drop_stored_facts()
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    try:
        model = models.forest(spark, DATA)
        recent, latest = models.recent_rows(spark, DATA), models.latest_rows(spark, DATA)
        facts = V.stored_facts(spark, DATA)
        tables = [spark.read.parquet(str(p)) for p in tmp_path.iterdir()]
        wide = [t.count() for t in tables if "revenue_lag_28" in t.columns]
        assert len(wide) == 2 and max(wide) < facts.count() / 5 and model.features
        assert latest.select("campaign_id").distinct().count() == facts.select("campaign_id").distinct().count()
        whole = models.feature_table(spark, DATA)
        same = whole.join(latest.select("campaign_id", "date"), ["campaign_id", "date"], "left_semi").select(latest.columns)
        assert same.exceptAll(latest).count() == latest.exceptAll(same).count() == 0 < recent.count()
    finally:
        V.drop_stored_facts()

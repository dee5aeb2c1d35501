import os
import re

import pytest
from pyspark.sql import functions as F

from tidemark.errors import SourceError
from tidemark.session import cut_lineage
from tidemark.session import release as session_release
from tidemark.sources import tables as T


def test_panel_round_trip(two_campaigns, spark, tmp_path):
    path = str(tmp_path / "store")
    T.write_panel(two_campaigns, path)
    assert {p for p in os.listdir(path) if p.startswith("platform")} == {"platform=google", "platform=meta"}
    back = T.read_feature_store(spark, path)
    assert back.count() == 70 and set(back.columns) == set(two_campaigns.columns)
    plan = back.filter("platform = 'meta'").select("spend")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(platform" in plan


def test_predictions_are_never_appended(two_campaigns, spark, tmp_path):
    path = str(tmp_path / "predictions.csv")
    for _ in range(2):
        T.write_predictions_csv(two_campaigns.select("campaign_id", "date", F.col("spend").alias("p50")), path)
    back = T.read_feature_store(spark, path)
    assert back.count() == 70 and dict(back.dtypes)["date"] == "date"


def test_stored_table_keeps_schema_and_prunes(two_campaigns):
    stored = cut_lineage(two_campaigns)
    assert stored.schema.simpleString() == two_campaigns.schema.simpleString() and stored.count() == 70
    plan = stored.select("spend")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<spend:double>" in plan


def test_no_plan_is_keyed_by_platform_alone(two_campaigns):
    from tidemark.operators.features import build_feature_store
    from tidemark.operators.harmonize import flag_maturity

    plan = build_feature_store(flag_maturity(two_campaigns))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(platform#\d+, \d+\)", plan)
    assert plan.count("Window [") <= 2 and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


@pytest.mark.parametrize("suffix", ["csv", "parquet"])
def test_formats_by_suffix(two_campaigns, spark, tmp_path, suffix):
    path = str(tmp_path / f"x.{suffix}")
    getattr(two_campaigns.select("campaign_id", "date", "spend").write.option("header", True), suffix)(path)
    assert T.read_feature_store(spark, path).count() == 70


def test_forecasts_do_not_shuffle_facts_by_segment(spark, two_campaigns):
    from tidemark.operators.quantiles import SegmentQuantiles

    rows = two_campaigns.selectExpr("*", "weekday(date) AS weekday")
    scored = SegmentQuantiles.fit(rows, ["platform", "weekday"]).predict(rows)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_intermediate_tables_need_a_shared_folder_on_a_cluster():
    from tidemark import session

    class Fake:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master = "spark://somewhere:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        session.shared_folder(Fake)


def test_stored_tables_can_be_released(two_campaigns):
    stored = cut_lineage(two_campaigns)
    session_release(stored)
    assert not os.path.exists(stored.stored_at)


def test_redelivery_touches_its_own_months_only(two_campaigns, spark, tmp_path):
    path = str(tmp_path / "months")
    T.redeliver(two_campaigns, path)  # begins the panel: January and February 2024

    def files():
        return {os.path.join(f, n): os.stat(os.path.join(f, n)).st_mtime_ns for f, _, ns in os.walk(path) for n in ns if n.endswith(".parquet")}

    def rows():
        back = T.read_months(spark, path)
        assert set(back.columns) == set(two_campaigns.columns)
        return sorted(map(tuple, back.select(*two_campaigns.columns).collect()), key=repr)

    first, before = files(), rows()
    assert before == sorted(map(tuple, two_campaigns.collect()), key=repr)
    late = two_campaigns.where("date >= DATE '2024-02-02' AND platform = 'google'").withColumn("spend", F.lit(1.5))
    for _ in range(2):  # again: nothing more changes
        T.redeliver(late, path)
        want = two_campaigns.where("NOT (date >= DATE '2024-02-02' AND platform = 'google')").unionByName(late)
        assert rows() == sorted(map(tuple, want.collect()), key=repr)
    untouched = [f for f in first if "stored_month=2024-01" in f or "platform=meta" in f]
    assert len(untouched) == 3 and all(files()[f] == first[f] for f in untouched)
    assert T.read_months(spark, path, since="2024-02").count() == 8
    T.redeliver(late.where("false"), path)
    assert rows() == sorted(map(tuple, want.collect()), key=repr)
    with pytest.raises(SourceError):
        T.redeliver(late.withColumn("date", F.lit(None).cast("date")), path)
    # A campaign that a day no longer lists is gone from it.
    T.redeliver(late.where("date = DATE '2024-02-02'").withColumn("campaign_id", F.lit("other")), path)
    assert T.read_months(spark, path).where("platform = 'google' AND date = DATE '2024-02-02'").select("campaign_id").collect() == [("other",)]

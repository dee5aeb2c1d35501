"""Lines become days by one sort instead of hash tables, and the panel's order is checked without whole paths."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.plans import products
from tidemark.plans import tables as V

LINES = ("l_suppkey bigint, l_shipdate timestamp, l_orderkey bigint, l_quantity double, l_extendedprice double, l_discount double, "
         "l_tax double, l_returnflag string")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, 3, None]), dt.datetime(2024, 1, rng.randint(1, 5), rng.randint(0, 23)), rng.choice([7, 8, 9, None]),
             float(rng.randint(1, 50)), rng.randint(100, 9999) / 100, 0.05, rng.choice([0.0, 0.08]), rng.choice("RAN")) for _ in range(200)]
    rows += [(4, dt.datetime(2024, 1, 1), None, 2.0, 10.0, 0.0, 0.1, "A"), (4, dt.datetime(2024, 1, 1), None, 3.0, 20.0, 0.0, None, None)]
    rows += [(4, None, 5, 1.0, 10.0, 0.0, 0.1, "R"), (4, None, 5, 1.0, 10.0, 0.0, 0.1, "R"), (4, dt.datetime(2024, 1, 2), 5, None, None, 0.0, 0.1, "A")]
    path = str(tmp_path_factory.mktemp("lines"))
    spark.createDataFrame(rows, LINES).write.parquet(f"{path}/lineitem.parquet")
    return path


def test_days_equal_grouped_lines(spark, folder):
    price = F.col("l_extendedprice")
    grouped = V.table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("campaign_id"), F.to_date("l_shipdate").alias("date")).agg(
        F.round(F.sum(price * F.col("l_tax")) + 1e-5, 2), F.round(F.sum(F.expr(
            "CASE WHEN l_returnflag <> 'R' THEN l_extendedprice * (1 - l_discount) ELSE 0.0 END")) + 1e-5, 2),
        F.sum("l_quantity"), F.sum("l_quantity") * 100, F.count_distinct("l_orderkey").cast("double"))
    got = V.daily_lines(spark, folder)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, grouped.collect()), key=str)
    assert got.count() == got.select("campaign_id", "date").distinct().count()


def test_no_hash_table_of_lines(spark, folder):
    assert "Aggregate" not in V.daily_lines(spark, folder)._jdf.queryExecution().executedPlan().toString()


def test_order_of_the_panel_sorts_no_paths(spark, monkeypatch):
    facts = spark.range(60).selectExpr("CASE id % 2 WHEN 0 THEN 'bing' ELSE 'meta' END platform", "id % 6 campaign_id",
                                       "date_add(DATE'2024-01-01', int(id / 6)) date", "double(id) spend")
    monkeypatch.setattr(V, "facts", lambda *_: facts)
    out = products.panel_order(spark, "")
    assert sorted(map(tuple, out.collect())) == [("bing", 30, 0), ("meta", 30, 0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "file_path" not in re.sub(r"file:\S+", "", plan) and "file_name" in plan


def test_order_of_the_panel_sees_late_rows(spark, monkeypatch):
    """Files of two platforms may share their names; a file's rows are still compared with that file's alone."""
    rows = [("bing", 1, 3), ("bing", 1, 1), ("bing", 2, 2), ("meta", 1, 1), ("meta", 1, 2), ("meta", 1, 2)]
    facts = spark.createDataFrame(rows, "platform string, campaign_id bigint, date int")
    monkeypatch.setattr(V, "facts", lambda *_: facts)
    monkeypatch.setattr(products.T, "write_panel", lambda df, path: df.coalesce(1).write.partitionBy("platform").parquet(path))
    assert sorted(map(tuple, products.panel_order(spark, "").collect())) == [("bing", 3, 1), ("meta", 3, 1)]

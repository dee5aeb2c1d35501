import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import tune  # noqa: E402

START = dt.date(2024, 1, 1)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return tune(session)


FACT_SCHEMA = (
    "platform string, campaign_id string, campaign_name string, date date, spend double, revenue_attributed double, "
    "clicks double, impressions double, conversions double, daily_budget double, channel_format string, "
    "reach double, video_views double, attribution_mature boolean"
)


@pytest.fixture(scope="session")
def two_campaigns(spark):
    """Two arithmetic series of 35 days."""
    rows = []
    for cid, platform, slope in (("camp_A", "google", 1.0), ("camp_B", "meta", 2.0)):
        for i in range(35):
            k = i + 1
            rows.append((platform, cid, f"{cid}_Campaign_01", START + dt.timedelta(days=i), k * 10.0 * slope,
                         k * 100.0 * slope, float(k), k * 100.0, k * 0.1, 500.0, "Search", 0.0, 0.0, True))
    return spark.createDataFrame(rows, FACT_SCHEMA).cache()

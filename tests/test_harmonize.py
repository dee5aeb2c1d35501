import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.errors import QualityError
from tidemark.operators import harmonize as H
from tidemark.operators import quality as Q
from tidemark.roles import CANONICAL_SCHEMA
from tidemark.sources import platforms as S


def frame(spark, contract, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in contract.types.items()))


D = dt.date


@pytest.fixture(scope="module")
def exports(spark):
    google = frame(spark, S.GOOGLE, [
        (1, D(2024, 1, d), 5, 1.0, 2_500_000, 100, 7, 40.0, "VIDEO", 10.0, "Search_TM_Campaign_01") for d in (1, 15, 16)
    ] + [(2, D(2024, 1, 2), 5, 1.0, 0, 100, 7, float("nan"), "HOTEL", None, "Pmax_Campaign_02")])
    meta = frame(spark, S.META, [(3, D(2024, 3, 1), 0.1, 0.2, 0.3, 9.0, 4.0, 2.0, 50.0, 8.0, None,
                                  "Prospecting_Adv_Plus_Campaign_01")])
    bing = frame(spark, S.BING, [(4, D(2024, 2, 1), 6.0, 3.0, 1, 20, 0.5, "Audience", 10.0, "Search_TM_Campaign_01")])
    return google, meta, bing


def test_canonical_shape_and_values(exports):
    out = H.harmonize(*exports)
    assert dict(out.dtypes) == CANONICAL_SCHEMA and out.columns == list(CANONICAL_SCHEMA)
    rows = {(r.platform, r.campaign_id, r.date.day): r for r in out.collect()}
    assert len(rows) == 6
    g = rows["google", 1, 1]
    assert g.spend == 2.5 and g.channel_format == "UpperFunnel" and g.reach is None and g.video_views == 7.0
    other = rows["google", 2, 2]
    assert other.channel_format == "Other" and other.revenue_attributed is None and other.spend == 0.0
    m = rows["meta", 3, 1]
    assert m.revenue_attributed == 8.0 and m.conversions is None and m.channel_format == "PMax"
    assert rows["bing", 4, 1].channel_format == "UpperFunnel"


def test_maturity_is_per_platform(exports):
    rows = {(r.platform, r.date): r.attribution_mature for r in H.harmonize(*exports).collect()}
    assert rows["google", D(2024, 1, 2)] is True
    assert rows["google", D(2024, 1, 15)] is False and rows["google", D(2024, 1, 16)] is False
    assert rows["meta", D(2024, 3, 1)] is False


@pytest.mark.parametrize("column, text", [("spend", "negative_spend"), ("revenue_attributed", "negative_revenue")])
def test_negative_values_raise(exports, column, text):
    bad = H.harmonize(*exports).withColumn(column, F.lit(-1.0))
    with pytest.raises(QualityError, match=text):
        Q.enforce(Q.fact_violations(bad), bad)


def test_duplicates_count_every_row(exports):
    facts = H.harmonize(*exports)
    twice = facts.unionByName(facts.filter("platform = 'bing'"))
    found = {r.check_name: r.n_rows for r in Q.fact_violations(twice).collect()}
    assert found == {"negative_spend": 0, "negative_revenue": 0, "duplicate_key": 2}
    with pytest.raises(QualityError, match="duplicate_key: 2"):
        Q.enforce(Q.fact_violations(twice), twice)


@pytest.mark.parametrize("name, channel", [
    ("Prospecting_Adv_Plus_Campaign_01", "PMax"), ("Prospecting_DPA_Campaign_01", "Shopping"),
    ("Remarketing_Brand_Campaign_01", "Brand"), ("Remarketing_Campaign_1", "Remarketing"),
    ("Prospecting_Campaign_1", "Prospecting"), ("Generic_Campaign_01", "Other"), ("dpa", "Other"), (None, "Other"),
])
def test_meta_channel(spark, name, channel):
    from tidemark.functions.names import meta_channel
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(meta_channel("n")).first()[0] == channel


def test_maturity_of_any_platform(spark):
    rows = [(p, D(2024, 1, 1) + dt.timedelta(days=i)) for p, n in (("google", 40), ("somewhere", 20)) for i in range(n)] + [(None, D(2024, 1, 1))]
    df = H.flag_maturity(spark.createDataFrame(rows, "platform string, date date"))
    found = {r.platform: r.n for r in df.groupBy("platform").agg(F.count_if("attribution_mature").alias("n")).collect()}
    assert found == {"google": 26, "somewhere": 6, None: 0}

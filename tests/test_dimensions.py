import datetime as dt

import pytest

from tidemark.errors import PanelError, QualityError
from tidemark.functions import dates as DT
from tidemark.operators import taxonomy as X
from tidemark.operators.calendar import CALENDAR_COLUMNS, calendar_covering, holiday_calendar

NAMES = [
    # platform, name, format, audience, funnel, product, number, key, brand, non-brand
    ("google", "Pmax_NTM_Campaign_01", "Pmax", "NTM", None, None, 1, "google_Pmax_NTM", False, True),
    ("google", "Search_TM_Campaign_02", "Search", "TM", None, None, 2, "google_Search_TM", True, False),
    ("bing", "Demand Gen_NTM_Campaign_01", "Demand Gen", "NTM", None, None, 1, "bing_Demand_Gen_NTM", False, True),
    ("google", "Pmax_Campaign_01", "Pmax", None, None, None, 1, "google_Pmax", False, False),
    ("google", "_TM_Campaign_x", None, "TM", None, None, None, "google_TM", True, False),
    ("google", "A_Campaign_1_Campaign_2", "A", None, None, None, None, "google_A", False, False),
    ("meta", "Prospecting_Adv_Plus_Campaign_01", None, None, "Prospecting", "Adv_Plus", 1,
     "meta_Prospecting_Adv_Plus", False, True),
    ("meta", "Remarketing_Brand_Campaign_02", None, None, "Remarketing", "Brand", 2, "meta_Remarketing_Brand", True, False),
    ("meta", "Generic_Campaign_01", None, None, "Generic", None, 1, "meta_Generic", False, False),
    ("meta", "Prospectingx_Campaign_01", None, None, None, None, 1, "meta", False, False),
    ("bing", "no token", "no token", None, None, None, None, "bing_no_token", False, False),
    ("meta", "no token", None, None, None, None, None, "meta", False, False),
]


@pytest.fixture(scope="module")
def dim(spark):
    rows = [(p, i, n, "UpperFunnel" if i == 0 else "Search") for i, (p, n, *_) in enumerate(NAMES)]
    df = spark.createDataFrame(rows, "platform string, campaign_id bigint, campaign_name string, channel_format string")
    return {r.campaign_id: r for r in X.parse_taxonomy(df).collect()}


@pytest.mark.parametrize("i", range(len(NAMES)))
def test_parsed_names(dim, i):
    r = dim[i]
    got = (r.platform, r.campaign_name, r.format, r.audience_strategy, r.funnel_stage, r.ad_product_type,
           r.campaign_number, r.strategy_key, r.is_brand, r.is_non_brand)
    assert got == NAMES[i] and r.is_upper_funnel == (i == 0)


def test_cross_engine_pairs_and_uniqueness(spark):
    rows = [("google", 1, "A_Campaign_1"), ("bing", 2, "A_Campaign_1"), ("google", 3, "B_Campaign_1"),
            ("meta", 4, "C_Campaign_1"), ("bing", 5, "C_Campaign_1")]
    df = spark.createDataFrame([(*r, "Search") for r in rows],
                               "platform string, campaign_id bigint, campaign_name string, channel_format string")
    flags = {r.campaign_id: r.cross_engine_pair_flag for r in X.parse_taxonomy(df, check=True).collect()}
    assert flags == {1: True, 2: True, 3: False, 4: False, 5: False}
    dup = df.unionByName(spark.createDataFrame([("google", 9, "A_Campaign_1", "Search")], df.schema))
    with pytest.raises(QualityError, match="duplicate_name"):
        X.parse_taxonomy(dup, check=True)


@pytest.fixture(scope="module")
def cal(spark):
    df = holiday_calendar(spark, 2024, 2027)
    assert df.columns == CALENDAR_COLUMNS
    return {r.date: r for r in df.collect()}


def test_calendar_truths(cal):
    D = dt.date
    assert len(cal) == 1461
    assert cal[D(2024, 11, 28)].holiday_name == "Thanksgiving Day"
    bf = cal[D(2024, 11, 29)]
    assert bf.holiday_name == "Black Friday" and bf.holiday_intensity_score == 1.0 and not bf.is_holiday and bf.is_bfcm
    assert cal[D(2024, 12, 2)].holiday_name == "Cyber Monday" and cal[D(2024, 12, 2)].days_since_black_friday == 3
    assert cal[D(2024, 7, 16)].holiday_name == "Prime Day (approx)"
    assert cal[D(2024, 7, 16)].holiday_intensity_score == 0.55
    assert cal[D(2024, 11, 1)].holiday_intensity_score == 0.3
    assert cal[D(2024, 8, 1)].holiday_intensity_score >= 0.25 and cal[D(2024, 6, 15)].holiday_intensity_score < 0.1
    assert cal[D(2025, 5, 26)].holiday_name == "Memorial Day" and cal[D(2025, 9, 1)].holiday_name == "Labor Day"
    assert sum(r.is_cyber_week for d, r in cal.items() if d.year == 2026) == 5
    assert sum(r.is_holiday for d, r in cal.items() if d.year == 2027) == 10


def test_calendar_distances_by_search(cal):
    bfs = sorted(d for d, r in cal.items() if r.holiday_name == "Black Friday")
    for d, r in cal.items():
        later = [x for x in bfs if x >= d]
        if later:
            assert r.days_to_black_friday == (later[0] - d).days
        earlier = [x for x in bfs if x <= d]
        if earlier:
            assert r.days_since_black_friday == (d - earlier[-1]).days


def test_calendar_arguments(spark):
    with pytest.raises(TypeError):
        holiday_calendar(spark, "2024", 2025)
    with pytest.raises(PanelError):
        holiday_calendar(spark, 2025, 2024)
    with pytest.raises(PanelError):
        holiday_calendar(spark, 2025, 2101)
    with pytest.raises(Exception, match="no 5-th"):
        spark.range(1).select(DT.nth_weekday(2024, 2, 0, 5)).collect()


def test_covering_calendar_spans_whole_years(spark, two_campaigns):
    assert calendar_covering(two_campaigns).count() == 366

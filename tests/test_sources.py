import datetime as dt

import pytest

from tidemark.errors import SourceError
from tidemark.sources import platforms as S
from tidemark.sources.tables import read_feature_store

HEADER = ",date_start,campaign_id,cpc,cpm,ctr,reach,spend,clicks,impressions,conversion,daily_budget,campaign_name"


def write(tmp_path, *lines, header=HEADER):
    path = tmp_path / "meta.csv"
    path.write_text("\n".join([header, *lines]) + "\n")
    return str(path)


def test_cast_by_name_whatever_the_order(spark, tmp_path):
    path = write(tmp_path, "0,2024-05-23,120210921616440533,0.1,1.0,2.0,0.0,12.5,3.0,100.0,77.5,,Generic_Campaign_01")
    row = S.read_meta(spark, path).first()
    assert row.campaign_id == 120210921616440533 and row.date_start == dt.date(2024, 5, 23)
    assert row.spend == 12.5 and row.conversion == 77.5 and row.daily_budget is None
    assert "_c0" not in S.read_meta(spark, path).columns


def test_missing_values_are_null_not_nan(spark, tmp_path):
    path = write(tmp_path, "0,2024-05-23,1,nan,NaN,NA,,1,1,1,1,null,x")
    row = S.read_meta(spark, path).first()
    assert [row.cpc, row.cpm, row.ctr, row.reach, row.daily_budget] == [None] * 5


def test_date_fallback_and_bad_date(spark, tmp_path):
    path = write(tmp_path, "0,05/23/2024,1,1,1,1,1,1,1,1,1,1,x")
    assert S.read_meta(spark, path).first().date_start == dt.date(2024, 5, 23)
    bad = write(tmp_path, "0,not a date,1,1,1,1,1,1,1,1,1,1,x")
    with pytest.raises(Exception, match="date_start"):
        S.read_meta(spark, bad).collect()


def test_bad_number_raises_and_is_counted(spark, tmp_path):
    path = write(tmp_path, "0,2024-01-01,1,abc,1,1,1,1,1,1,1,1,x", "1,2024-01-02,1.5,2,1,1,1,1,1,1,1,1,x")
    with pytest.raises(Exception, match="cannot read column"):
        S.read_meta(spark, path).collect()
    found = {r.column_name: r.n_bad for r in S.cast_failures(S.read_text(spark, path), S.META).collect()}
    assert found == {"cpc": 1, "campaign_id": 1}


def test_contract_missing_and_extra(spark, tmp_path):
    path = write(tmp_path, "0,1", header=",campaign_id")
    with pytest.raises(SourceError, match="missing columns"):
        S.read_meta(spark, path)
    path = write(tmp_path, "0,2024-05-23,1,1,1,1,1,1,1,1,1,1,x,keep", header=HEADER + ",extra")
    assert S.read_meta(spark, path).first().extra == "keep"


def test_profile_names_null_columns(spark):
    df = spark.createDataFrame([(1, None, dt.date(2024, 1, 1)), (1, 2.0, dt.date(2024, 1, 3))],
                               "id int, v double, day date")
    row = S.profile({"x": (df, "day", "id")}).first()
    assert (row.n_rows, row.n_campaigns, row.n_null_cells, row.null_columns) == (2, 1, 1, "v")
    assert (row.min_date, row.max_date) == (dt.date(2024, 1, 1), dt.date(2024, 1, 3))


def test_unsupported_store_format(spark):
    with pytest.raises(SourceError):
        read_feature_store(spark, "/x/store.xlsx")

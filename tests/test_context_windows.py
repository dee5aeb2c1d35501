"""The document of the portfolio reads the days it looks at, and says the same as over all days."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import context as X
from tidemark.operators import insights as I
from tidemark.operators import risks as K
from tidemark.plans import models
from tidemark.plans import response as R
from tidemark.plans import tables as V

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not present")
def test_document_over_its_windows(spark):
    rows = V.stored_facts(spark, DATA)
    # The supplied tables thin out towards their end; without the last weeks every section has entries.
    rows = rows.filter(F.col("date") <= rows.agg(F.date_sub(F.max("date"), 130)).scalar())
    whole_fc = V.forecast(spark, DATA, rows).localCheckpoint()
    fc, recent = models._context_windows(rows, whole_fc)
    end = rows.agg(F.max("date")).first()[0]
    assert fc.agg(F.min("date")).first()[0] > end - dt.timedelta(days=14) and fc.count() < whole_fc.count() / 20
    assert recent.agg(F.min("date")).first()[0] > end - dt.timedelta(days=30) and recent.count() < rows.count() / 20
    curves = R.curves(spark, DATA).localCheckpoint()

    def document(f, r):
        doc = json.loads(X.context_json(X.context_summary(f, curves), I.all_insights(f, r), K.all_risks(r, curves, f)).first()[0])
        for t in doc["top_campaigns"]:
            t["share_pct"] = round(t["share_pct"], 6)
        return doc

    first, second = document(whole_fc, rows), document(fc, recent)
    assert first == second and first["insights"] and first["risks"] and first["top_campaigns"]
    keys = lambda df: sorted(map(str, df.collect()))
    assert keys(K.zero_revenue_risk(recent)) == keys(K.zero_revenue_risk(rows))

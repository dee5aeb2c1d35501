"""The lines of the facts are dealt out once, by campaign, and not again for distinct orders, days or the join."""

import os
import re

import pytest

from tidemark.plans import tables as V

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not present")
def test_lines_are_dealt_out_by_campaign_alone(spark):
    plan = V.facts(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\((.*?), \d+\), (\w+)", plan)
    assert [re.sub(r"#\w+", "", keys) for keys, why in dealt if why == "REPARTITION_BY_COL"] == ["campaign_id"]
    assert not any("orderkey" in keys or keys.startswith("campaign_id") and "date" in keys for keys, _ in dealt)

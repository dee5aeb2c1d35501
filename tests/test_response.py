import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.errors import CurveError
from tidemark.functions import curves as C
from tidemark.operators import allocate as A
from tidemark.operators import recommend as N
from tidemark.operators import response as P
from tidemark.operators import risks as K
from tidemark.operators import scenarios as S

SCHEMA = ("platform string, campaign_id bigint, campaign_name string, date date, spend double, "
          "revenue_attributed double, attribution_mature boolean")
CURVE = ("campaign_id bigint, campaign_name string, platform string, v_max double, k double, n double, r_squared double, "
         "is_reliable boolean, avg_daily_spend double, avg_daily_revenue double")


def hill(x, v, k, n):
    return 0.0 if x <= 0 else v / (1 + (x / k) ** -n)


def panel_rows(cid, spend, revenue, platform="google", immature=14):
    days = len(spend)
    return [(platform, cid, f"c{cid}", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(s), float(r), i < days - immature)
            for i, (s, r) in enumerate(zip(spend, revenue))]


@pytest.fixture(scope="module")
def fits(spark):
    rng = np.random.default_rng(7)
    x = rng.uniform(10, 1500, 80)
    rows = panel_rows(1, x, [hill(s, 1000, 500, 1.5) for s in x])
    rows += panel_rows(2, x[:10], x[:10], immature=7)             # three points
    rows += panel_rows(3, [100.0] * 40, rng.uniform(50, 60, 40))  # constant spend
    rows += panel_rows(4, [0.0] * 40, [0.0] * 40)
    rows += panel_rows(5, x, rng.uniform(0, 1000, 80))            # noise
    rows += panel_rows(6, [5.0] * 10, [9.0] * 10, immature=10)    # nothing mature
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.campaign_id: r for r in P.response_curves(df).collect()}


def test_fit_recovers_parameters(fits):
    r = fits[1]
    assert r.v_max == pytest.approx(1000, rel=1e-3) and r.k == pytest.approx(500, rel=1e-3)
    assert r.n == pytest.approx(1.5, rel=1e-3) and r.r_squared > 0.99999 and r.fit_reason == "ok"
    assert 0 < r.saturation_score < 1 and r.n_training_rows == 66


def test_fallbacks(fits):
    assert fits[2].fit_reason == "linear fallback: too few nonzero points (3)" and fits[2].n == 1.0
    assert fits[3].fit_reason == "linear fallback: spend variance too low"
    roas = fits[3].v_max / fits[3].k
    assert 0.5 < roas < 0.6 and fits[3].r_squared == 0.0 and not fits[3].is_reliable
    assert fits[4].v_max == 1e6 and fits[4].k == 1e6 and fits[4].saturation_score == 0.0 and fits[4].current_roas == 0.0
    assert not fits[5].is_reliable and fits[5].fit_reason.startswith("low R²")
    assert fits[6].avg_daily_spend == 5.0 and fits[6].avg_daily_revenue == 9.0 and fits[6].n_training_rows == 0


def test_refinement_never_worsens(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(1, 900, 60)
    y = [max(hill(s, 700, 300, 2.2) + e, 0) for s, e in zip(x, rng.normal(0, 20, 60))]
    df = spark.createDataFrame(panel_rows(1, x, y), SCHEMA)
    coarse, fine = (P.fit_hill(df, refinements=i).first().r_squared for i in (0, 8))
    assert fine >= coarse > 0.8


def test_curve_functions(spark):
    df = spark.createDataFrame([(1000.0, 500.0, 1.5, x) for x in (0.0, 1e-6, 250.0, 500.0, 1e9)],
                               "v_max double, k double, n double, x double")
    rows = df.select("x", C.hill("x").alias("f"), C.marginal_roas("x").alias("m"), C.saturation("x").alias("s"),
                     C.spend_for_saturation(C.saturation("x")).alias("back")).collect()
    assert [r.f for r in rows][0] == 0.0 and rows[0].m == pytest.approx(3.0) and rows[3].f == 500.0
    h = 1e-4
    assert rows[2].m == pytest.approx((hill(250 + h, 1000, 500, 1.5) - hill(250 - h, 1000, 500, 1.5)) / (2 * h), rel=1e-6)
    assert rows[2].back == pytest.approx(250) and rows[4].s == pytest.approx(1.0)
    lift = spark.range(1).select(C.lift_pct(F.lit(5.0), F.lit(0.0)), C.lift_pct(F.lit(0.0), F.lit(0.0))).first()
    assert lift[0] == float("inf") and lift[1] == 0.0


def curves_of(spark, params, platform="google"):
    rows = [(i, f"c{i}", platform, float(v), float(k), float(n), 0.9, True, float(s), float(hill(s, v, k, n)))
            for i, (v, k, n, s) in enumerate(params)]
    df = spark.createDataFrame(rows, CURVE)
    return df.withColumns({"saturation_score": C.saturation("avg_daily_spend"),
                           "current_marginal_roas": C.marginal_roas("avg_daily_spend"),
                           "current_roas": F.lit(1.0)})


def test_allocation_invariants(spark):
    rng = np.random.default_rng(5)
    params = [(v, k, n, s) for v, k, n, s in zip(rng.uniform(500, 5000, 40), rng.uniform(100, 2000, 40),
                                                rng.uniform(0.4, 1.0, 40), rng.uniform(50, 1500, 40))]
    curves = curves_of(spark, params)
    got = A.allocate_budget(curves)
    rows, summary = got.table.collect(), got.summary.first()
    assert got.converged and summary.converged and summary.budget_error < 1e-6 * summary.total_budget
    interior = []
    for r in rows:
        assert 0.6 * r.baseline_spend - 1e-6 <= r.optimal_spend <= 1.4 * r.baseline_spend + 1e-6
        if 0.601 * r.baseline_spend < r.optimal_spend < 1.399 * r.baseline_spend:
            interior.append(r.optimal_marginal_roas)
    assert len(interior) > 3 and max(interior) - min(interior) < 1e-4 * max(interior)
    assert summary.revenue_lift >= 0 and 0 <= summary.risk_score <= 1


def test_s_curves_match_brute_force(spark):
    params = [(400, 120, 0.8, 100), (500, 150, 0.9, 120), (300, 160, 2.5, 150)]
    budget = 370.0
    lo, hi = np.array([60, 72, 90.0]), np.array([140, 168, 210.0])
    best = 0.0
    for a in np.linspace(lo[0], hi[0], 401):
        for b in np.linspace(lo[1], hi[1], 401):
            c = budget - a - b
            if lo[2] <= c <= hi[2]:
                best = max(best, sum(hill(x, *p[:3]) for x, p in zip((a, b, c), params)))
    s = A.allocate_budget(curves_of(spark, params), budget).summary.first()
    assert s.budget_error < 1e-6 and s.optimal_total_revenue >= best * (1 - 1e-5)


def test_identical_s_curves_share_a_jump(spark):
    curves = curves_of(spark, [(1000, 300, 4.0, 200)] * 30)
    got = A.allocate_budget(curves, 6000.0)
    s = got.summary.first()
    assert s.budget_error < 1e-5 and s.optimal_total_revenue > s.baseline_total_revenue


def test_constraints_and_errors(spark):
    curves = curves_of(spark, [(1000, 300, 0.9, 200), (800, 300, 0.8, 300)])
    fixed = spark.createDataFrame([(0, 50.0, 60.0)], "campaign_id bigint, min_daily_spend double, max_daily_spend double")
    rows = {r.campaign_id: r for r in A.allocate_budget(curves, 400.0, fixed).table.collect()}
    assert 50 <= rows[0].optimal_spend <= 60 and rows[1].optimal_spend == pytest.approx(400 - rows[0].optimal_spend)
    assert not A.allocate_budget(curves, 5000.0).summary.first().converged
    with pytest.raises(CurveError):
        A.allocate_budget(curves, -1.0)
    with pytest.raises(CurveError):
        A.allocate_budget(curves.filter("false"))


def test_scenarios(spark):
    curves = curves_of(spark, [(1000, 300, 0.9, 200), (800, 300, 1.8, 300)]).withColumn(
        "avg_daily_revenue", F.col("avg_daily_revenue") + 17.0)
    rows = {r.scenario: r for r in S.standard_scenarios(curves).collect()}
    assert rows["Baseline"].revenue_lift == 0.0 and rows["Baseline"].new_spend == 500.0
    assert rows["Google Boost"].new_spend == pytest.approx(600.0)
    for r in rows.values():
        assert r.ci_low <= r.projected_revenue <= r.ci_high and 0 <= r.risk_score <= 1
    custom = {r.campaign_id: r for r in S.apply_scenario(
        curves, S.Scenario("x", "", {"google": 2.0}, {1: -5.0})).collect()}
    assert custom[0].new_daily_spend == 400.0 and custom[1].new_daily_spend == 0.0
    assert custom[1].projected_daily_revenue == 0.0


def test_risks_and_recommendations(spark):
    curves = curves_of(spark, [(1000, 10, 1.5, 200), (5000, 900, 0.9, 300), (900, 100, 1.0, 250), (700, 100, 1.2, 400)])
    found = {r.campaign_id: r.severity for r in K.saturation_risk(curves).collect()}
    assert found == {"0": "critical", "3": "high"}
    risk = K.concentration_risk(curves).first()
    assert risk.metric_value == 100.0 and risk.title == "Google receives 100% of total spend"
    quick = N.quick_recommendations(curves).collect()
    assert quick and quick[0].type == "increase_budget" and quick[0].target_campaign_id == "1"
    recs = N.recommendations(A.allocate_budget(curves).table).collect()
    assert 0 < len(recs) <= 5 and any(r.type == "reallocate" for r in recs)
    assert [r.priority for r in recs] == sorted((r.priority for r in recs), key=["high", "medium", "low"].index)

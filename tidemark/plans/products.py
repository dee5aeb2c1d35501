"""Round trips through sources and sinks, and the model operators with models that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import in_last, last_date
from tidemark.functions.metrics import METRIC_NAMES
from tidemark.operators import backtest as B
from tidemark.operators import folds as O
from tidemark.operators import harmonize as H
from tidemark.operators import quality as Q
from tidemark.operators import rollout as L
from tidemark.operators.quantiles import SegmentQuantiles, repair_quantiles
from tidemark.plans import forecasts as P
from tidemark.plans import tables as V
from tidemark.plans.features import WINDOWED_SQL, feature_table
from tidemark.plans.ingest import FACT_DOUBLES, FACT_KEYS, raw_exports
from tidemark.plans.models import forest, recent_rows
from tidemark.plans.registry import query
from tidemark.session import cut_lineage, shared_folder
from tidemark.sources import tables as T
from tidemark.sources.platforms import CONTRACTS, DATE_PATTERNS

# ---- sources and sinks ---------------------------------------------------------------------------------------


def _folder(spark):
    return f"{shared_folder(spark).rstrip('/')}/products-{uuid.uuid4().hex}"


@query("csv_round_trip", FACT_KEYS, FACT_DOUBLES, source="facts", ctes=V.FACTS_SQL)
def csv_round_trip(spark, d):
    """The three exports as CSV files with a row index, read under their contracts and harmonized with all checks."""
    folder = _folder(spark)
    for contract, df in zip(CONTRACTS.values(), raw_exports(spark, d)):
        absent = {c: F.lit(None).cast(t) for c, t in contract.types.items() if c not in df.columns}
        rows = df.withColumns(absent).select(F.monotonically_increasing_id().alias("_c0"), *contract.types)
        rows.write.option("header", True).csv(f"{folder}/{contract.filename}")
    return H.harmonize_from_dir(spark, folder)


@query("csv_dates_round_trip", FACT_KEYS, FACT_DOUBLES, source="facts", ctes=V.FACTS_SQL)
def csv_dates_round_trip(spark, d):
    """The exports with every accepted way of writing a day, row by row in turn, and without the row index."""
    folder = _folder(spark)
    for contract, df in zip(CONTRACTS.values(), raw_exports(spark, d)):
        columns = []
        for name, kind in contract.types.items():
            value = F.col(name) if name in df.columns else F.lit(None).cast(kind)
            if kind == "date" and name in df.columns:
                day = F.col(name).cast("date")
                turn = F.pmod(F.xxhash64(*df.columns), F.lit(len(DATE_PATTERNS)))
                value = F.coalesce(*[F.when(turn == i, F.date_format(day, pattern)) for i, pattern in enumerate(DATE_PATTERNS)])
            columns.append(value.alias(name))
        df.select(*columns).write.option("header", True).csv(f"{folder}/{contract.filename}")
    return H.harmonize_from_dir(spark, folder)


@query("panel_round_trip", FACT_KEYS, FACT_DOUBLES, source="facts", ctes=V.FACTS_SQL)
def panel_round_trip(spark, d):
    folder = _folder(spark)
    T.write_panel(V.facts(spark, d), folder)
    return T.read_feature_store(spark, folder)


@query("panel_redelivery", FACT_KEYS, FACT_DOUBLES, source="facts", ctes=V.FACTS_SQL)
def panel_redelivery(spark, d):
    """A panel whose last 14 days were wrong and listed every campaign twice, after these days were delivered anew."""
    folder, facts = _folder(spark), V.stored_facts(spark, d)
    late = in_last("date", last_date(facts), 14)
    wrong = facts.where(late).withColumn("revenue_attributed", F.col("revenue_attributed") * 2)
    ghosts = wrong.withColumn("campaign_id", -1 - F.col("campaign_id"))
    T.write_months(facts.where(~late).unionByName(wrong).unionByName(ghosts), folder)
    T.redeliver(facts.where(late), folder)
    return T.read_months(spark, folder)


@query("panel_order", ["platform", "n_rows", "n_out_of_order"], ctes=V.FACTS_SQL, source="""(
    SELECT platform, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_out_of_order FROM facts GROUP BY platform)""")
def panel_order(spark, d):
    """Rows of the written panel that do not follow the row before them in their file by campaign and day."""
    folder = _folder(spark)
    T.write_panel(V.facts(spark, d), folder)
    stored = spark.read.parquet(folder).select(
        "platform", "campaign_id", "date", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    # The name alone names a file of a platform; whole paths would make up most of what a task sorts.
    before = Window.partitionBy("platform", "file").orderBy("at")
    key = F.struct("campaign_id", "date")
    late = F.coalesce(F.lag(key).over(before) >= key, F.lit(False))
    return stored.withColumn("late", late).groupBy("platform").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("late").alias("n_out_of_order"))


@query("model_round_trip", ["platform", "n_rows", "n_different"], ctes=V.FACTS_SQL, source="""(
    SELECT platform, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_different FROM facts
    WHERE attribution_mature AND date > (SELECT max(date) FROM facts WHERE attribution_mature) - 30 GROUP BY platform)""")
def model_round_trip(spark, d):
    """The last 30 mature days scored by a forest and by what is loaded after it was saved: rows whose quantiles differ."""
    folder, model, recent = _folder(spark), forest(spark, d), recent_rows(spark, d)
    model.save(folder)
    keys = ["date", "campaign_id"]
    first, second = (B.score_recent(recent, m).select(*keys, "platform", F.array("p10", "p50", "p90").alias("q")) for m in (model, model.load(folder)))
    both = first.join(second.withColumnRenamed("q", "again").drop("platform"), keys, "left")
    return both.groupBy("platform").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("q").eqNullSafe(F.col("again"))).alias("n_different"))


@query("forecast_sinks", ["sink", "platform", "n_rows", "n_future"], ["p50", "revenue_attributed"], ctes=V.FORECAST_SQL, digits=1, source="""(
    SELECT sink, platform, count(*) AS n_rows, count(*) FILTER (is_future) AS n_future, sum(p50) AS p50,
      sum(revenue_attributed) AS revenue_attributed
    FROM forecast, (VALUES ('csv'), ('table')) s(sink) GROUP BY sink, platform)""")
def forecast_sinks(spark, d):
    """The forecast written as prediction files and as a table, and what is read back of each."""
    folder, fc = _folder(spark), cut_lineage(V.forecast(spark, d))
    T.write_predictions_csv(fc, f"{folder}/csv")
    T.write_table(fc, f"{folder}/table")
    read = {"csv": spark.read.schema(fc.schema).csv(f"{folder}/csv", header=True), "table": spark.read.parquet(f"{folder}/table")}
    both = [df.withColumn("sink", F.lit(name)) for name, df in read.items()]
    return both[0].unionByName(both[1]).groupBy("sink", "platform").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("is_future").alias("n_future"), F.sum("p50").alias("p50"),
        F.sum("revenue_attributed").alias("revenue_attributed"))


@query("report_round_trip", ["n_folds", "fold_id", "n_val_mature"], METRIC_NAMES, ctes=P.METRICS_SQL,
       source="(SELECT *, (SELECT count(*) FROM per_fold) AS n_folds FROM per_fold)")
def report_round_trip(spark, d):
    """The evaluation report as JSON, read back and unfolded."""
    per_fold = cut_lineage(P._baseline_metrics(spark, d))
    path = _folder(spark)
    T.write_report(T.evaluation_report(per_fold, O.metric_summary(per_fold), ["platform", "weekday"]), path)
    return spark.read.json(path).select("n_folds", F.inline("fold_metrics"))


@query("feature_store_check", ["check_name", "n_rows"], ctes=V.FACTS_SQL, source="""(
    SELECT 'duplicate_grain' AS check_name, CAST(count(*) FILTER (attribution_mature) AS BIGINT) AS n_rows FROM facts)""")
def feature_store_check(spark, d):
    """The check finds every mature row of a store that holds them twice."""
    store = cut_lineage(feature_table(spark, d))
    return Q.feature_store_violations(store.unionByName(store.filter("attribution_mature")))


# ---- models that SQL can express ------------------------------------------------------------------------------

_SEASONAL = ["platform", "weekday"]


def _weekdays(spark, d):
    return V.stored_facts(spark, d).withColumn("weekday", F.weekday("date"))


@query("backtest_seasonal", ["fold_id", "train_start", "train_end", "val_start", "val_end", "n_train", "n_val_mature"], METRIC_NAMES,
       ctes=P.METRICS_SQL, source="""(SELECT per_fold.*, CAST(train_start AS VARCHAR) AS train_start, CAST(train_end AS VARCHAR) AS train_end,
         CAST(val_start AS VARCHAR) AS val_start, CAST(val_end AS VARCHAR) AS val_end, n_train FROM per_fold JOIN folds USING (fold_id))""")
def backtest_seasonal(spark, d):
    """Every fold of the default grid: the quantiles of its own training rows by platform and weekday."""
    return B.backtest(_weekdays(spark, d), score=B.score_segments(_SEASONAL))


@query("score_recent_seasonal", ["date", "campaign_id", "campaign_name", "platform", "is_future"],
       ["revenue_attributed", "p10", "p50", "p90"], ctes=V.FORECAST_SQL, source="""(
    SELECT * FROM forecast WHERE NOT is_future AND date > (SELECT max(date) FROM forecast WHERE NOT is_future) - 30)""")
def score_recent_seasonal(spark, d):
    rows = _weekdays(spark, d)
    return B.score_recent(rows, SegmentQuantiles.fit(rows.filter("attribution_mature"), _SEASONAL))


class LagRule:
    """A linear rule over yesterday, last week and the trailing week."""

    features = ("revenue_lag_1", "revenue_lag_7", "revenue_roll_mean_7")

    def predict(self, df):
        part = lambda c, w: F.coalesce(F.col(c), F.lit(0.0)) * w
        p50 = part("revenue_lag_1", 0.5) + part("revenue_lag_7", 0.2) + part("revenue_roll_mean_7", 0.2) + 10.0
        return repair_quantiles(df.withColumns({"p10": p50 * 0.8, "p50": p50, "p90": p50 * 1.25}))


STEPS_SQL = """last_day AS (SELECT max(date) AS m FROM facts),
    slots AS (SELECT campaign_id, campaign_name, platform, i FROM (SELECT DISTINCT campaign_id, campaign_name, platform FROM facts), range(60) r(i)),
    buffers AS (SELECT s.campaign_id, s.campaign_name, s.platform, list(f.revenue_attributed ORDER BY s.i DESC) AS buf
      FROM slots s CROSS JOIN last_day LEFT JOIN facts f ON f.campaign_id = s.campaign_id AND f.date = m - CAST(s.i AS INTEGER) GROUP BY ALL),
    steps AS (
      SELECT campaign_id, campaign_name, platform, 0 AS k, buf, CAST(NULL AS DOUBLE) AS p50 FROM buffers
      UNION ALL
      SELECT campaign_id, campaign_name, platform, k + 1, list_append(buf[2:], p), p FROM (
        SELECT *, coalesce(buf[60], 0) * 0.5 + coalesce(buf[54], 0) * 0.2 + coalesce(list_avg(buf[54:60]), 0) * 0.2 + 10 AS p FROM steps WHERE k < 14))"""
ROLLED_SQL = """SELECT CAST(m + k AS DATE) AS date, campaign_id, campaign_name, platform, true AS is_future, CAST(NULL AS DOUBLE) AS revenue_attributed,
  p50 * 0.8 AS p10, p50, p50 * 1.25 AS p90 FROM steps, last_day WHERE k > 0"""


@query("rollout_rule", ["date", "campaign_id", "campaign_name", "platform", "is_future"], ["p10", "p50", "p90"], digits=3,
       ctes=f"RECURSIVE {V.FACTS_SQL}, {STEPS_SQL}", source=f"({ROLLED_SQL})")
def rollout_rule(spark, d):
    rows = V.stored_facts(spark, d).select("date", "campaign_id", "campaign_name", "platform", "revenue_attributed")
    lags = {c: F.lit(None).cast("double") for c in ("revenue_lag_1", "revenue_lag_7", "revenue_roll_mean_7")}
    return L.forecast_rollout(rows.withColumns(lags), LagRule())


@query("scoring_path", ["date", "campaign_id", "campaign_name", "platform", "is_future"], ["revenue_attributed", "p10", "p50", "p90"], digits=3,
       ctes=f"RECURSIVE {WINDOWED_SQL}, {STEPS_SQL}", source=f"""({ROLLED_SQL} UNION ALL
    SELECT date, campaign_id, campaign_name, platform, false, revenue_attributed, p * 0.8, p, p * 1.25
    FROM (SELECT *, coalesce(revenue_lag_1, 0) * 0.5 + coalesce(revenue_lag_7, 0) * 0.2 + coalesce(revenue_roll_mean_7, 0) * 0.2 + 10 AS p FROM moved)
    WHERE attribution_mature AND date > (SELECT max(date) FROM facts WHERE attribution_mature) - 30)""")
def scoring_path(spark, d):
    """History scored with the stored features, then fourteen days ahead, in one table."""
    return L.score_portfolio(cut_lineage(feature_table(spark, d)), LagRule())

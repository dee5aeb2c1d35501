"""Stored products: feature store, predictions, forecasts, curves, evaluation report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import SourceError
from tidemark.functions.metrics import METRIC_NAMES
from tidemark.roles import PANEL, Roles
from tidemark.session import cut_lineage


def read_feature_store(spark: SparkSession, path: str) -> DataFrame:
    """Parquet or CSV by suffix; a path without a suffix is a Parquet folder."""
    leaf = path.rstrip("/").rsplit("/", 1)[-1]
    if leaf.endswith(".csv"):
        df = spark.read.csv(path, header=True, inferSchema=True)
        return df.withColumn("date", F.col("date").cast("date"))
    if leaf.endswith(".parquet") or "." not in leaf:
        return spark.read.parquet(path)
    raise SourceError(f"unsupported feature store format: {leaf} (use .parquet or .csv)")


def write_panel(df: DataFrame, path: str, roles: Roles = PANEL) -> None:
    """Parquet by platform, rows clustered by campaign and day so that date filters skip row groups.

    Rows are spread over (platform, campaign hash) rather than over platform alone: three
    platforms would otherwise mean three writers.
    """
    (
        df.repartition(roles.platform, roles.entity)
        .sortWithinPartitions(roles.platform, roles.entity, roles.date)
        .write.mode("overwrite").partitionBy(roles.platform).parquet(path)
    )


MONTH = "stored_month"  # partition column of the panel by months


def write_months(df: DataFrame, path: str, roles: Roles = PANEL) -> None:
    """The panel by platform and month; only the months that ``df`` has rows of are replaced.

    Rebalancing gives a month of a large platform several files and merges small ones, so that neither one
    writer nor a file per task and month results.  Files are in the order of campaign and day.
    """
    keys = [roles.platform, MONTH]
    rows = df.withColumn(MONTH, F.date_format(roles.date, "yyyy-MM")).hint("rebalance", *[F.col(c) for c in keys])
    (
        rows.sortWithinPartitions(*keys, roles.entity, roles.date)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    )


def read_months(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """The panel written by months; ``since`` ('yyyy-MM') leaves earlier months unread."""
    rows = spark.read.parquet(path)
    rows = rows.withColumn(MONTH, F.col(MONTH).cast("string"))
    return (rows if since is None else rows.where(F.col(MONTH) >= since)).drop(MONTH)


def redeliver(df: DataFrame, path: str, roles: Roles = PANEL) -> None:
    """Take a delivery into the panel at ``path``: its days replace what was stored of these days, platform by platform.

    Days that the delivery does not hold stay, and months without any of its days are neither read nor
    written.  A day is replaced whole: campaigns that it no longer lists are gone from it.  The same
    delivery twice changes nothing more.  A panel that does not exist yet is begun.  Rows need a day; an empty delivery
    does nothing.  The new months are stored in the shared folder before an old one is replaced.
    """
    if df.where(F.col(roles.date).isNull()).limit(1).count():
        raise SourceError("delivery: rows without a day")
    spark, new = df.sparkSession, cut_lineage(df)
    month = F.date_format(roles.date, "yyyy-MM")
    # A row per platform and month of the delivery.
    months = [(r[0], r[1]) for r in new.select(roles.platform, month).distinct().collect()]
    if not months:
        return
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        stored = spark.read.parquet(path).withColumn(MONTH, F.col(MONTH).cast("string"))
        touched = stored.where(F.col(roles.platform).isin(sorted({p for p, _ in months if p is not None}))
                               & F.col(MONTH).isin(sorted({m for _, m in months})))
        days = new.select(F.col(roles.platform).alias("_platform"), F.col(roles.date).alias("_day")).distinct()
        same = F.col(roles.platform).eqNullSafe(F.col("_platform")) & (F.col(roles.date) == F.col("_day"))
        # Months of a platform that are read along with others' but not delivered are not written again.
        among = F.struct(roles.platform, MONTH).isin([F.struct(F.lit(p), F.lit(m)) for p, m in months if p is not None])
        kept = touched.where(among).drop(MONTH).join(days, same, "left_anti")
        new = cut_lineage(kept.unionByName(new, allowMissingColumns=True))
    write_months(new, path, roles)


def write_predictions_csv(df: DataFrame, path: str) -> None:
    """Fresh CSV folder; never appends to older predictions."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str) -> None:
    """Forecasts, curves and allocations are plain tables."""
    df.write.mode("overwrite").parquet(path)


def evaluation_report(fold_metrics: DataFrame, summary: DataFrame, feature_columns: list[str]) -> DataFrame:
    """One-row nested report: aggregates, per-fold list (a handful of folds), feature names."""
    one_fold = F.struct("fold_id", *[c for c in fold_metrics.columns if c != "fold_id"])
    folds = fold_metrics.agg(F.array_sort(F.collect_list(one_fold))).scalar()
    keys = [f"{stat}_{m}" for m in METRIC_NAMES for stat in ("mean", "std")]
    return summary.select(
        fold_metrics.agg(F.count(F.lit(1))).scalar().alias("n_folds"),
        F.lit(len(feature_columns)).alias("n_features"),
        F.array(*[F.lit(c) for c in feature_columns]).alias("feature_columns"),
        F.struct(*keys).alias("aggregated_metrics"),
        folds.alias("fold_metrics"),
    )


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)

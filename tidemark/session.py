"""Session settings the library is tuned for, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcast on measured size only: estimates of aggregated or joined inputs can be far off, so
    # the planner never guesses and AQE converts a join once it has seen how small a side is.
    # Sides with a proven bound (calendar, folds) carry an explicit hint.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Small inputs still use every core: compute-heavy stages here often read very little.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HotSpot never compiles a method of more than 8 000 bytes; a stage over wide rows that would become one is left to
    # operators whose code Spark cuts into small methods, instead of being interpreted row by row.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Below this value Spark adds up the sizes of all columns after every row that goes to Python; batches of numbers
    # are bounded by their rows (spark.sql.execution.arrow.maxRecordsPerBatch).  Texts: see ``llm.common.prepare``.
    "spark.sql.execution.arrow.maxBytesPerBatch": "2147483647",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; the cluster's own partition counts are kept."""
    for key, value in RECOMMENDED_CONF.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a temporary one only where Spark runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut_lineage(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write a frame to the shared folder and continue from the stored table.

    A table survives the loss of any executor, and unlike a row checkpoint it keeps column pruning
    and size statistics for whatever reads it next.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def free_shuffles(spark: SparkSession) -> None:
    """Have the shuffles removed that nothing refers to any more.

    Spark removes a shuffle once the driver's collector has found that nothing refers to it, which an idle driver may
    put off for half an hour; asking for it keeps the disks of the executors from filling up meanwhile.
    """
    spark._jvm.System.gc()


def release(*stored: DataFrame) -> None:
    """Delete tables that ``cut_lineage`` wrote and nothing reads any more, and shuffles that only they needed."""
    for df in stored:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if stored:
        free_shuffles(stored[0].sparkSession)

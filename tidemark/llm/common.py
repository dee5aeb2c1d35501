"""What the operators share: tables, session settings, whole texts in tasks, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut_lineage, release, tune

#: Rows and bytes of an Arrow batch.  Texts can be long, so a task holds few of them at a time.
BATCH_ROWS, BATCH_BYTES = "512", "64MB"
#: ASCII white space, the only separator of words that the contracts know.
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_bytes(text: str = "text") -> Column:
    """The whole text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw")


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: str = "doc_id") -> Column:
    """Every fifth document by CRC-32 of its id; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict[str, list]]]:
    """Each batch with its columns as Python lists."""
    for batch in batches:
        yield batch, {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (a long, b long): one row (node, component) per linked node.

    The component is its smallest node.  In each round every node hooks onto its smallest neighbour
    and then onto that node's own choice; links are renamed to what their ends hooked onto, and
    those inside one tree go away.  Local minima alone stay, so the rounds grow with the logarithm
    of the nodes.  Null ends and loops are ignored; repeated links count once; no links, no rows.
    """
    a, b = F.col("a"), F.col("b")
    links = cut_lineage(edges.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    labels = None
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select(
            "node", F.least("node", "least").alias("to"))
        onto = hooks.select(F.col("node").alias("to"), F.col("to").alias("root"))
        trees = cut_lineage(hooks.join(onto, "to").select("node", "root"))
        renamed = links.join(trees, links.a == trees.node).select("root", "b").withColumnRenamed("root", "ra")
        renamed = renamed.join(trees, renamed.b == trees.node).select(F.col("ra"), F.col("root").alias("rb"))
        ends = renamed.where("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        after = cut_lineage(ends.distinct())
        if labels is None:
            relabelled = trees.withColumnRenamed("root", "component")
        else:
            relabelled = cut_lineage(labels.join(trees, labels.component == trees.node, "left").select(
                labels.node, F.coalesce(trees.root, labels.component).alias("component")))
            release(labels, trees)
        release(links)
        if labels is None:
            relabelled.stored_at = trees.stored_at
        labels, links = relabelled, after
    release(links)
    return labels if labels is not None else edges.select(a.alias("node"), b.alias("component")).limit(0)

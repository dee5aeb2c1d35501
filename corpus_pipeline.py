"""The corpus pipeline: documents in, token ids out, one stage after the other.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is stored before the next one
reads it.  All but the last return the columns of ``documents``.  Null texts count as empty; rows
with null ids go through like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, secrets, similar, toxicity
from tidemark.llm.common import prepare, table
from tidemark.session import cut_lineage


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half.  Labels come from the labels table."""
    return toxicity.kept(docs, table(prepare(spark), sf_dir, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest id.

    Links are texts whose five-word shingles have a Jaccard similarity of 0.8 or more, with an id or without; SimHash
    proposes pairs, and prefix filtering those that four bits do not reach.
    """
    prepare(spark)
    return similar.distinct_documents(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced."""
    prepare(spark)
    return secrets.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    prepare(spark)
    return mixing.remixed(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): the token ids of every text."""
    prepare(spark)
    return bpe.encoded(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", simhash_stage),
    ("secret_scan", secrets_stage),
    ("source_mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: Toxicity is learned and cannot be written as SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(prepare(spark), sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs

"""SimHash near-dedup by multi-index hashing.

A fingerprint is cut into three segments.  Two fingerprints that differ in at most ``DISTANCE`` = 4
bits agree on the last segment or differ in at most one bit of one of the first two, because
(1 + 1) + (1 + 1) + (0 + 1) > 4.  Every fingerprint is stored under the value of each of its
segments and under the values one bit away; a value with the bit set meets it from the other
side, so that only unset bits have to be flipped.  What meets in a table cell is verified on all
64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import components, rows_of, table, text_bytes, unused
from tidemark.llm.registry import query
from tidemark.session import cut_lineage

DISTANCE = 4
SHINGLE = 4
SEED = 42
#: (first bit, bits, flips) of the segments.
SEGMENTS = ((0, 22, 1), (22, 22, 1), (44, 20, 0))
#: Shingles hashed at a time, which bounds a task's memory for a text of any length.
CHUNK = 16_384
#: A table cell with more rows than this is dealt out as pairs of blocks of about this many rows.
CELL = 1_024


def hash_chunks(raw: bytes, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of a text's word shingles, repeats included, ``CHUNK`` at a time; nothing if it has no word."""
    words = raw.lower().split()
    if not words:
        return
    line = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(line)]
    n = max(1, len(words) - shingle + 1)
    ends = ends[min(shingle, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        spans = zip(starts[at:min(at + CHUNK, n)], ends[at:at + CHUNK])
        yield np.array([digest(line[s:e], SEED) for s, e in spans], "<u8")


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a text's word shingles, repeats included; zero if it has no word."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in hash_chunks(raw, shingle):
        n += len(hashes)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long, hash): the fingerprint of every whole text, as a signed integer, and a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, c in rows_of(batches):
            fps = np.array([fingerprint(x) for x in c["raw"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), batch.column(2)], ["doc_id", "fp", "hash"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text), text_hash(text).alias("hash"))
    return rows.mapInArrow(run, "doc_id long, fp long, hash long")


def text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def cells(fps: DataFrame) -> DataFrame:
    """(seg, key, own, fp, node): every table cell in which a fingerprint is stored or looked up."""
    probes = []
    for seg, (first, bits, flips) in enumerate(SEGMENTS):
        key = f"CAST(shiftrightunsigned(fp, {first}) & {(1 << bits) - 1} AS INT)"
        probes.append(f"array(struct({seg} AS seg, {key} AS key, true AS own))")
        if flips:
            probes.append(f"filter(transform(sequence(0, {bits - 1}), b -> struct({seg} AS seg, {key} | shiftleft(1, b) AS key,"
                          f" false AS own)), x -> x.key != {key})")
    return fps.select("fp", "node", F.explode(F.expr(f"concat({', '.join(probes)})")).alias("c")).select("c.*", "fp", "node")


def dealt(rows: DataFrame, cell: int = CELL) -> DataFrame:
    """Groups (members array of (fp, node)) that together hold every pair of each table cell.

    A cell of more than ``cell`` rows is split into blocks; a group then is a pair of blocks, so that
    no group grows with the cell.
    """
    sizes = rows.groupBy("seg", "key").agg(F.count("*").alias("n"))
    large = cut_lineage(sizes.where(F.col("n") > cell))
    small = rows if large.isEmpty() else rows.join(large, ["seg", "key"], "left_anti")
    member = F.struct("fp", "node")
    groups = small.groupBy("seg", "key").agg(F.collect_list(member).alias("members"), F.max("own").alias("own"))
    groups = groups.where(F.col("own") & (F.size("members") > 1)).select("members")
    if large.isEmpty():
        return groups
    blocks = F.ceil(F.col("n") / cell).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(
        F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")))
    hot = rows.join(large, ["seg", "key"]).withColumn("blocks", blocks)
    hot = hot.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).withColumn("pair", F.explode(pair))
    return groups.union(hot.groupBy("seg", "key", "pair").agg(F.collect_list(member).alias("members")).select("members"))


def verified(groups: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) that span the groups' pairs at ``distance`` or less: a chain for each member, not every pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            members, at = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            fps = members.field(0).to_numpy(zero_copy_only=False).view(np.uint64)
            nodes = members.field(1).to_numpy(zero_copy_only=False)
            a, b = [], []
            for lo, hi in zip(at[:-1], at[1:]):
                found = spanning(fps[lo:hi], nodes[lo:hi], distance)
                if found is not None:
                    a.append(found[0])
                    b.append(found[1])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return groups.mapInArrow(run, "a long, b long")


def spanning(fps: np.ndarray, nodes: np.ndarray, distance: int):
    """Each member with the smallest node that links inside the group lead it to."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance
    if np.count_nonzero(near) == len(fps):
        return None
    label = nodes
    while True:
        lower = np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (lower == label).all():
            break
        label = lower
    moved = label != nodes
    return nodes[moved], label[moved]


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp long, hash, component_id): documents whose fingerprints are linked by steps of ``distance`` bits or less.

    The component is the smallest doc_id in reach.  Null texts count as empty and empty texts get
    fingerprint zero, linked like any other.  Rows with equal fingerprints are one node from the
    start, so copies are never paired; every row comes back, repeated ones as often as they occur.
    Rows with a null doc_id get the component of their fingerprint and lead to no other.
    ``distance`` may be at most 4, which the segments guarantee.
    """
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"distance must be between 0 and {DISTANCE}")
    prints = cut_lineage(fingerprints(docs, doc_id, text))
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    known = nodes.where(F.col("node").isNotNull())
    comps = components(verified(dealt(cells(known)), distance))
    named = nodes.join(comps, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "hash", "component_id")


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, unchanged, that stand for their group of near duplicates.

    That is the row of the smallest id; of rows that share it, the one whose text has the smallest
    hash.  Where no row of a group has an id, one row per fingerprint stays.
    """
    return distinct_rows(docs, near_duplicates(docs))


def distinct_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``distinct_documents`` for the groups (doc_id, fp, hash, component_id) in ``found``."""
    named = found.where("doc_id = component_id").groupBy("doc_id").agg(F.min("hash").alias("hash"))
    nameless = found.where("component_id IS NULL").groupBy("fp").agg(F.min("hash").alias("hash"))
    stays = named.union(nameless.select(F.lit(None).cast("long").alias("doc_id"), "hash"))
    key, repeat = unused(docs, "row_key"), unused(docs, "repeat")
    stays = stays.select(row_key(F.col("doc_id"), F.col("hash")).alias(key)).distinct()
    rows = docs.withColumn(key, row_key(F.col("doc_id").cast("long"), text_hash("text"))).join(stays, key, "left_semi")
    number = F.row_number().over(Window.partitionBy(key).orderBy(key))
    return rows.withColumn(repeat, number).where(F.col(repeat) == 1).select(docs.columns)


def row_key(doc_id: Column, text: Column) -> Column:
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), text.cast("string"))


@query("op9_simhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

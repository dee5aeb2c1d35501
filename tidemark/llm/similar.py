"""Near-dedup of the pipeline: links of exact word-shingle similarity, found by SimHash and by prefix filtering.

The similarity of two texts is the Jaccard similarity of their sets of ``SHINGLE``-word shingles.  If
all sets are written in one order, two sets of similarity t or more share one of the first
n - ceil(t n) + 1 shingles of each, so that cells of equal leading shingles hold every link.  The
order is by hash, with shingles of many texts last; any order would do, this one keeps cells small.

SimHash by multi-index hashing (operator 9) proposes sets whose fingerprints differ in four bits at most; similar sets
may differ in more, which is what the cells are for.  Every proposed pair that its leading shingles do not rule out is verified on
the sets themselves.

In a cell all texts are first compared with the cell's smallest one; then every pair of texts is
compared that the links of the first round have not put together: as a list of pairs where few texts meet, in
pairs of blocks where many do.  No cell is cut.

Rows without an id are compared like all others; a group that has none but such rows has no smallest id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, rows_of, text_bytes
from tidemark.llm.simhash import cells as print_cells
from tidemark.llm.simhash import dealt, distinct_rows, hash_chunks, text_hash, verified
from tidemark.session import cut_lineage, release

SHINGLE, SIMILARITY = 5, 0.8
#: Texts from which a leading shingle counts as common, and how many of the most common ones go last.
COMMON, COMMONEST = 32, 200_000
#: A bundle with more members than this is dealt out as pairs of blocks, of about four times as many members or this many shingles.
CELL, BLOCK_SHINGLES = 256, 1 << 20
#: Shingles of a bundle that are looked at together.
WIDE = 4_096
#: Pairs of one set that are verified together, and sets to be placed that travel to the texts by broadcast.
BLOCK, BROADCAST_PLACES = 64, 500_000
#: What tells texts apart: whether the row has an id, the id (zero without one), a hash of the text.
KEY = ["named", "doc_id", "hash"]
SETS = "fp long, size long, lead array<long>, print long"


def shingles(raw: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of a text's distinct word shingles, ascending; none if it has no word."""
    found = [np.unique(h) for h in hash_chunks(raw, shingle)]
    return np.unique(np.concatenate(found)).view(np.int64) if found else np.zeros(0, np.int64)


def set_key(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def sketch(hashes: np.ndarray) -> int:
    """SimHash of a set of shingles, as a signed integer; zero if it is empty."""
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def leading(hashes: np.ndarray, similarity: float, common: np.ndarray) -> np.ndarray:
    """The shingles of which two sets of ``similarity`` share one at least."""
    n = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1 if len(hashes) else 0
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        hashes = hashes[np.argsort(common[at] == hashes, kind="stable")]
    return hashes[:n]


def sets_of(docs: DataFrame, shingle: int, similarity: float, common: np.ndarray) -> DataFrame:
    """(named, doc_id, hash, fp, size, lead, print) of every row of (named, doc_id, raw, hash): a hash of its set, the set's size, leading shingles and SimHash."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, c in rows_of(batches):
            sets = [shingles(raw, shingle) for raw in c["raw"]]
            lead = [leading(s, similarity, shared.value) for s in sets]
            columns = [*[batch.column(k) for k in KEY], pa.array([set_key(s) for s in sets], pa.int64()),
                       pa.array([len(s) for s in sets], pa.int64()), pa.array(lead, pa.list_(pa.int64())),
                       pa.array([sketch(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*KEY, "fp", "size", "lead", "print"])

    return docs.select(*KEY, "raw").mapInArrow(run, f"named boolean, doc_id long, hash long, {SETS}")


def once(rows: DataFrame) -> DataFrame:
    """``rows`` to look texts up in: those without an id once per text, since any number may share it."""
    return rows.where("named").union(rows.where("NOT named").dropDuplicates(["hash"]))


def by_bits(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of set hashes, a < b, that span what SimHash links among (fp, print): equal prints, and prints at four bits or less."""
    prints = cut_lineage(nodes.groupBy("print").agg(F.min("fp").alias("node")))
    same = nodes.join(prints, "print").where("fp != node").select(F.col("node").alias("a"), F.col("fp").alias("b"))
    near = verified(dealt(print_cells(prints.withColumnRenamed("print", "fp"))))
    return same.union(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def sets_at(places: DataFrame, keys: list[str], nodes: DataFrame, docs: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """((fp, keys, set binary): the set of every row of (fp, keys), the stored table that it reads).

    Where the rows are few, the texts stay where they are until they are sets.
    """
    placed = cut_lineage(places.join(nodes.select("fp", *KEY), "fp"))
    few = placed.count() <= BROADCAST_PLACES
    texts = once(docs).join(F.broadcast(placed) if few else placed, KEY).select("raw", "fp", *keys)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None, None
        for batch, c in rows_of(batches):
            # A text that goes to several places comes in rows that follow each other.
            found = []
            for raw in c["raw"]:
                if raw != before[0]:
                    before = raw, shingles(raw, shingle).tobytes()
                found.append(before[1])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("fp", *keys)), pa.array(found, pa.binary())], ["fp", *keys, "set"])

    kinds = dict(placed.dtypes)
    return texts.mapInArrow(sets, f"fp long, {', '.join(f'{k} {kinds[k]}' for k in keys)}, set binary"), placed


def dealt_out(pairs: DataFrame) -> DataFrame:
    """(fp, a, block): both sides of every pair; the pairs of each a in blocks of about ``BLOCK``, every b once, a once per block."""
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    dealt = pairs.join(pairs.groupBy("a").count(), "a").select("a", "b", F.pmod(F.xxhash64("b"), blocks).cast("int").alias("block"))
    return dealt.select(F.col("b").alias("fp"), "a", "block").union(dealt.select(F.col("a").alias("fp"), "a", "block").distinct())


def most_in_common(x: tuple[np.ndarray, int], y: tuple[np.ndarray, int], common: np.ndarray) -> int:
    """An upper bound of what two sets share, from the (leading shingles, size) of each.

    Up to where the leading shingles of one set end, those of the other are known too: what the sets share
    there is counted, and what is left of either bounds the rest.
    """
    if not len(x[0]) or not len(y[0]):
        return 0

    def rank(h: int) -> tuple[bool, int]:
        at = min(int(np.searchsorted(common, h)), len(common) - 1)
        return bool(len(common)) and int(common[at]) == h, h

    ends = rank(int(x[0][-1])), rank(int(y[0][-1]))
    (lead, size), (other, other_size), end = (x, y, ends[0]) if ends[0] <= ends[1] else (y, x, ends[1])
    # How many of the other's shingles come no later than that end, by halves: they stand in the order of ranks.
    lo, hi = 0, len(other)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if rank(int(other[mid])) <= end else (lo, mid)
    return len(np.intersect1d(lead, other[:lo], assume_unique=True)) + min(size - len(lead), other_size - lo)


def promising(pairs: DataFrame, found: DataFrame, nodes: DataFrame, common: np.ndarray, similarity: float) -> DataFrame:
    """The pairs (a, b) of set hashes, stored, that may reach ``similarity`` by their leading shingles, which alone travel for it."""
    placed = cut_lineage(dealt_out(pairs).join(nodes.select("fp", *KEY), "fp"))
    few = placed.count() <= BROADCAST_PLACES
    leads = once(found.select("fp", *KEY, "size", "lead")).join(F.broadcast(placed) if few else placed, ["fp", *KEY])
    shared = pairs.sparkSession.sparkContext.broadcast(common)

    def sift(group: pa.Table) -> pa.Table:
        hub, common = group["a"][0].as_py(), shared.value
        sets = [one.values.to_numpy() for chunk in group["lead"].chunks for one in chunk]
        held = dict(zip(group["fp"].to_pylist(), zip(sets, group["size"].to_pylist())))
        x, keep = held.pop(hub), []
        for fp, y in held.items():
            most = most_in_common(x, y, common)
            if most and most / (x[1] + y[1] - most) >= similarity:
                keep.append(fp)
        return pa.table({"a": pa.array([hub] * len(keep), pa.int64()), "b": pa.array(keep, pa.int64())})

    left = cut_lineage(leads.select("fp", "a", "block", "size", "lead").groupBy("a", "block").applyInArrow(sift, "a long, b long"))
    release(placed)
    return left


def linked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of set hashes whose sets have ``similarity`` or more.

    Sets travel as ``dealt_out`` says.  Where the pairs are few the texts stay where they are until they are sets.
    """
    found, placed = sets_at(dealt_out(pairs), ["a", "block"], nodes, docs, shingle)

    def verify(group: pa.Table) -> pa.Table:
        hub = group["a"][0].as_py()
        held = dict(zip(group["fp"].to_pylist(), group["set"].to_pylist()))
        x, keep = np.frombuffer(held.pop(hub), np.int64), []
        for fp, y in held.items():
            y = np.frombuffer(y, np.int64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            if shared / (len(x) + len(y) - shared) >= similarity:
                keep.append(fp)
        return pa.table({"a": pa.array([hub] * len(keep), pa.int64()), "b": pa.array(keep, pa.int64())})

    links = cut_lineage(found.groupBy("a", "block").applyInArrow(verify, "a long, b long"))
    release(placed)
    return links


def bundles(rows: DataFrame) -> DataFrame:
    """(hub, fp, hs, size, component, n, total): the cells (h, fp, size, component, hub) of each hub as one bundle, where its n members differ in component.

    ``total`` are the shingles of all members.

    Near copies share many cells, most of them of one hub; in a bundle a pair is looked at once.
    """
    held = rows.groupBy("hub", "fp").agg(F.collect_list("h").alias("hs"), F.first("size").alias("size"), F.first("component").alias("component"))
    sizes = held.groupBy("hub").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.min("component").alias("low"), F.max("component").alias("high"))
    return held.join(sizes.where("low < high").select("hub", "n", "total"), "hub")


def across(small: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a, b) of bundles that share a cell, differ in ``component`` and whose sizes allow ``similarity``."""
    groups = small.groupBy("hub").agg(F.collect_list(F.struct("fp", "size", "component", "hs")).alias("members")).select("members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members in batch.column(0):
                m = members.values
                f, s, c = (m.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                fits = (f[:, None] < f[None, :]) & (c[:, None] != c[None, :])
                fits &= np.minimum(s[:, None], s[None, :]) / np.maximum(s[:, None], s[None, :]) >= similarity
                if fits.any():
                    hs = m.field(3)
                    a, b = np.nonzero(fits & (in_common(hs.flatten().to_numpy(), hs.value_lengths().to_numpy()) > 0))
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(f[a]), pa.array(f[b])], ["a", "b"])

    return groups.mapInArrow(run, "a long, b long").distinct()


def in_common(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many numbers each two of some lists share; the lists stand one after the other in ``flat``."""
    n = len(lengths)
    _, number, times = np.unique(flat, return_inverse=True, return_counts=True)
    owner, together = np.repeat(np.arange(n), lengths), np.zeros((n, n), np.float32)
    # What one list holds alone it shares with none but itself.
    alone = times[number] == 1
    together[np.arange(n), np.arange(n)] = np.bincount(owner[alone], minlength=n)
    number, owner = (np.cumsum(times > 1) - 1)[number[~alone]], owner[~alone]
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    ends = np.searchsorted(number, np.arange(0, (int(number[-1]) if len(number) else 0) + WIDE + 1, WIDE))
    for k, (lo, hi) in enumerate(zip(ends, ends[1:])):
        if lo < hi:
            holds = np.zeros((n, WIDE), np.float32)
            holds[owner[lo:hi], number[lo:hi] - k * WIDE] = 1
            together += holds @ holds.T
    return together


def linked_within(large: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, similarity: float, cell: int) -> DataFrame:
    """Links (a, b) that span what is similar in bundles of many members, without writing their pairs.

    A bundle is dealt out as pairs of blocks; a set travels once to each pair of its block, and all sets that
    meet are compared by counting what they share.  A member gives one link to the smallest it leads to.
    """
    blocks = F.ceil(F.greatest(F.col("n") / (4 * cell), F.col("total") / BLOCK_SHINGLES)).cast("int")
    members = large.select("hub", "fp", blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("block"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(
        F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")))
    dealt = members.select("hub", "fp", F.inline(pair))
    found, placed = sets_at(dealt, ["hub", "i", "j"], nodes, docs, shingle)

    def verify(group: pa.Table) -> pa.Table:
        held = dict(zip(group["fp"].to_pylist(), group["set"].to_pylist()))
        fps, sets = np.array(list(held), np.int64), [np.frombuffer(v, np.int64) for v in held.values()]
        size = np.array([len(x) for x in sets])
        shared = in_common(np.concatenate(sets), size)
        near = shared / np.maximum(size[:, None] + size[None, :] - shared, 1) >= similarity
        np.fill_diagonal(near, True)
        label = fps
        while True:
            lower = np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1)
            if (lower == label).all():
                break
            label = lower
        moved = label != fps
        return pa.table({"a": pa.array(label[moved], pa.int64()), "b": pa.array(fps[moved], pa.int64())})

    links = cut_lineage(found.groupBy("hub", "i", "j").applyInArrow(verify, "a long, b long"))
    release(placed)
    return links


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, fp long, hash, component_id): documents linked by steps of ``similarity`` or more.

    ``fp`` is a hash of the set of shingles; equal sets are one node from the start, so copies are never
    paired.  A text of fewer words is one shingle; texts without words are equal.  The component is
    the smallest doc_id in reach, null where no row in reach has one.  Rows with a null doc_id link like any other.
    """
    return grouped(docs, doc_id, text, shingle, similarity).select("doc_id", "fp", "hash", "component_id")


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``near_duplicates`` with component: the smallest set hash in reach, which groups without any doc_id have too."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    number = F.col(doc_id).cast("long")
    rows = docs.select(number.isNotNull().alias("named"), F.coalesce(number, F.lit(0)).alias("doc_id"), text_bytes(text), text_hash(text).alias("hash"))
    leads = sets_of(rows, shingle, similarity, np.zeros(0, np.int64)).select(F.explode("lead").alias("h"))
    often = leads.groupBy("h").count().where(F.col("count") > COMMON).orderBy(F.desc("count"), "h").limit(COMMONEST)
    common = np.sort(np.array(often.select("h").toPandas()["h"], np.int64))

    found = cut_lineage(sets_of(rows, shingle, similarity, common))
    prints = found.select(F.expr("CASE WHEN named THEN doc_id END").alias("doc_id"), "fp", "hash")
    # Of the rows of a set, one with an id stands for it if there is any.
    nodes = cut_lineage(found.groupBy("fp").agg(
        F.min_by(F.struct(*KEY), F.struct(~F.col("named"), "doc_id", "hash")).alias("first"), F.first("size").alias("size"), F.first("print").alias("print")).select("fp", "first.*", "size", "print"))
    # Dealt out by shingle once; cells of one set go away before anything else is done with them.
    cells = found.select("fp", "size", F.explode("lead").alias("h")).repartition(F.col("h"))
    hubs = cells.groupBy("h").agg(F.min(F.struct("fp", "size")).alias("hub"), F.max("fp").alias("high")).where("hub.fp < high")
    shared = cut_lineage(cells.join(hubs.select("h", "hub"), "h").distinct())

    fits = F.least("size", "hub.size") / F.greatest("size", "hub.size") >= similarity
    first = cut_lineage(shared.where((F.col("fp") != F.col("hub.fp")) & fits).select(F.col("hub.fp").alias("a"), F.col("fp").alias("b")).union(
        by_bits(nodes)).distinct())
    hopeful = promising(first, found, nodes, common, similarity)
    links = linked(hopeful, nodes, rows, shingle, similarity)
    release(hopeful)
    joined = components(links).withColumnRenamed("node", "fp")
    placed = shared.join(joined, "fp", "left").select(
        "h", "fp", "size", F.coalesce("component", "fp").alias("component"), F.col("hub.fp").alias("hub"))
    mixed = cut_lineage(bundles(placed))
    second = cut_lineage(across(mixed.where(F.col("n") <= CELL), similarity).join(first, ["a", "b"], "left_anti"))
    hopeful = promising(second, found, nodes, common, similarity)
    more = linked(hopeful, nodes, rows, shingle, similarity)
    release(hopeful)
    large = linked_within(mixed.where(F.col("n") > CELL), nodes, rows, shingle, similarity, CELL)
    release(shared, first, second, mixed)

    comps = components(links.union(more).union(large)).withColumnRenamed("node", "fp")
    named = cut_lineage(nodes.join(comps, "fp", "left").select(
        "fp", F.expr("CASE WHEN named THEN doc_id END").alias("doc_id"), F.coalesce("component", "fp").alias("component")))
    release(links, more, large, nodes)
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "component").select("fp", "component", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "hash", "component", "component_id")


def distinct_documents(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, unchanged, that stand for their group; which one is as in ``simhash.distinct_rows``.

    Of a group without any id the text of the smallest hash stays.
    """
    found = grouped(docs, shingle=shingle, similarity=similarity)
    return distinct_rows(docs, found.select("doc_id", F.col("component").alias("fp"), "hash", "component_id"))

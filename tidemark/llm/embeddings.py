"""Embedding near-dedup with a forest of random-projection trees.

Each tree splits space by random hyperplanes through medians, again and again.  Vectors near a plane
spill over to both sides: the overlap is set by the angle that links pairs may have.  A node of
which no tried plane leaves most vectors on one side only stays a leaf, since splitting a cluster of near copies would
lose links.  Vectors are compared within leaves; each link counts in the first leaf that holds both
ends, so that no pair is written or counted twice.

Vectors of different lengths never link, so every length has a forest of its own; a length with no
more vectors than a leaf holds is one leaf.  The planes are fitted on a bounded sample
(``Settings.sample``, ``Settings.sample_bytes``); every vector is put into leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import components, table
from tidemark.llm.registry import query
from tidemark.session import cut_lineage


@dataclass(frozen=True)
class Settings:
    trees: int = 8
    leaf: int = 256  # vectors at which a node is not split further
    sample: int = 50_000  # distinct vectors of a length on which planes are fitted
    sample_bytes: int = 1 << 26  # and their bytes in all
    planes: int = 64  # random directions of each tree
    tries: int = 8  # directions looked at in a node
    spill: float = 0.3  # share of a node's vectors that may go to both sides
    least: int = 24  # sample vectors without which no node is split
    block: int = 1_024  # larger leaves are compared as pairs of blocks of about this many
    seed: int = 17


SETTINGS = Settings()
#: Bytes of vectors that are put into leaves together.
GATHERED = 1 << 24
KEYS = ["bytes", "leaf", "i", "j"]


@dataclass
class Tree:
    """Nodes: the direction, threshold and children of each, or the number of the leaf."""

    directions: np.ndarray
    margin: float
    plane: list[int] = field(default_factory=list)
    at: list[float] = field(default_factory=list)
    children: list[tuple[int, int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)

    def leaves(self, units: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(leaf, rows) of every leaf that rows fall into."""
        sides, found, open_nodes = units @ self.directions.T, [], [(0, np.arange(len(units)))]
        while open_nodes:
            node, rows = open_nodes.pop()
            if self.leaf[node] >= 0:
                found.append((self.leaf[node], rows))
                continue
            side = sides[rows, self.plane[node]] - self.at[node]
            for child, goes in zip(self.children[node], (side <= self.margin, side >= -self.margin)):
                if goes.any():
                    open_nodes.append((child, rows[goes]))
        return found


def grow(sample: np.ndarray, total: int, angle: float, settings: Settings, number: int, first_leaf: int) -> Tree:
    """A tree over ``sample``, whose nodes stand for ``total`` vectors in all."""
    rng = np.random.default_rng([settings.seed, number])
    directions = rng.standard_normal((settings.planes, sample.shape[1]))
    directions /= np.linalg.norm(directions, axis=1, keepdims=True)
    # Along a random direction, a linked pair lies this far apart in the root of the mean square.
    # Half of it on both sides of the plane keeps nearly all pairs together somewhere.
    margin = 0.5 * np.sqrt(2 - 2 * angle) / np.sqrt(sample.shape[1])
    tree, sides, scale = Tree(directions, margin), sample @ directions.T, total / max(1, len(sample))
    next_leaf, todo = first_leaf, [(np.arange(len(sample)), -1, 0)]
    while todo:
        rows, parent, hand = todo.pop()
        node = len(tree.plane)
        if parent >= 0:
            pair = list(tree.children[parent])
            pair[hand] = node
            tree.children[parent] = tuple(pair)
        best = None
        if len(rows) * scale > settings.leaf and len(rows) >= settings.least:
            for p in rng.choice(settings.planes, min(settings.tries, settings.planes), replace=False):
                along = sides[rows, p]
                middle = float(np.median(along))
                both = float((np.abs(along - middle) <= margin).mean())
                if both <= settings.spill and (best is None or both < best[0]):
                    best = both, int(p), middle
        tree.plane.append(best[1] if best else 0)
        tree.at.append(best[2] if best else 0.0)
        tree.children.append((-1, -1))
        tree.leaf.append(-1 if best else next_leaf)
        if best is None:
            next_leaf += 1
            continue
        side = sides[rows, best[1]] - best[2]
        todo += [(rows[side <= margin], node, 0), (rows[side >= -margin], node, 1)]
    return tree


def units_of(raws: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raws), kind).astype(np.float64).reshape(len(raws), -1)
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def number_kind(vectors: DataFrame, embedding: str) -> str:
    """Single precision where the column has it, so that vectors travel in half the bytes; else double."""
    column = vectors.schema[embedding].dataType
    return "f4" if isinstance(column, T.ArrayType) and isinstance(column.elementType, T.FloatType) else "f8"


def classes(vectors: DataFrame, vec_id: str, embedding: str, kind: str) -> DataFrame:
    """(vec_id, raw): every vector as the bytes of its numbers; null if it cannot link with anything."""

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        def one(v):
            if v is None:
                return None
            try:
                x = np.asarray(v, dtype=kind)
            except (TypeError, ValueError):  # a null component
                return None
            return (x + 0.0).tobytes() if len(x) and np.isfinite(x).all() and x.any() else None

        return pd.Series([one(v) for v in values], dtype="object")

    numbers = F.col(embedding).cast("array<float>" if kind == "f4" else "array<double>")
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), run(numbers).alias("raw"))


def gathered(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``GATHERED`` bytes of a column, so that what is done once per batch is done seldom."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= GATHERED:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def leaved(nodes: DataFrame, forests: dict[int, list[Tree]], kind: str) -> DataFrame:
    """(bytes, leaf, node, weight, raw, leaves): a row for each leaf that a vector is in; ``leaves`` are all of them, ascending.

    ``forests`` are the trees of each length in bytes; vectors of other lengths share one leaf per length.
    """
    shared = nodes.sparkSession.sparkContext.broadcast(forests)
    names = ["bytes", "leaf", "node", "weight", "raw", "leaves"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mixed in gathered(batches, "raw"):
            sizes = np.array([len(raw) for raw in mixed.column(2).to_pylist()], np.int64)
            for size in np.unique(sizes):
                batch = mixed.filter(pa.array(sizes == size))
                trees, n = shared.value.get(int(size)), batch.num_rows
                if trees:
                    units = units_of(batch.column(2).to_pylist(), kind)
                    pairs = [(np.full(len(rows), leaf, np.int32), rows) for t in trees for leaf, rows in t.leaves(units)]
                else:
                    pairs = [(np.zeros(n, np.int32), np.arange(n))]
                leaf, row = (np.concatenate(x) for x in zip(*pairs))
                order = np.lexsort((leaf, row))
                leaf, row = leaf[order], row[order]
                starts = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(leaf))
                # Long vectors in many leaves make large batches: a few thousand rows at a time.
                step = max(1, (1 << 24) // int(size))
                for lo in range(0, len(row), step):
                    take = pa.array(row[lo:lo + step])
                    columns = [pa.array(np.full(len(take), size, np.int32)), pa.array(leaf[lo:lo + step]),
                               *[batch.column(i).take(take) for i in range(3)], lists.take(take)]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return nodes.select("node", "weight", "raw").mapInArrow(
        run, "bytes int, leaf int, node long, weight long, raw binary, leaves array<int>")


def grouped(rows: DataFrame, block: int) -> DataFrame:
    """Rows with (bytes, leaf, i, j): one group for a small leaf, a group for each pair of blocks of a large one."""
    sizes = rows.groupBy(F.col("bytes").alias("s_bytes"), F.col("leaf").alias("s_leaf")).agg(F.count("*").alias("n"))
    # Only leaves to be cut into blocks: there are no more of them than nodes of trees over a bounded sample.
    large = sizes.where(F.col("n") > block)
    joined = rows.join(F.broadcast(large), (F.col("bytes") == F.col("s_bytes")) & (F.col("leaf") == F.col("s_leaf")), "left")
    blocks = F.ceil(F.coalesce("n", F.lit(1)) / block).cast("int")
    joined = joined.withColumn("blocks", blocks).withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(
        F.least(x, F.col("b")).alias("i"), F.greatest(x, F.col("b")).alias("j")))
    return joined.withColumn("p", F.explode(pairs)).select("bytes", "leaf", "p.i", "p.j", "b", "node", "weight", "raw", "leaves")


def compared(rows: DataFrame, cosine: float, kind: str) -> DataFrame:
    """(node, n, to) of all groups of ``grouped``.

    Groups are small and many: the rows of a partition are sorted by group, and a task cuts them apart itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in KEYS], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            found = []
            for lo, hi in zip(cuts, cuts[1:]):
                now = tuple(keys[lo].tolist())
                if held and now != key:
                    found.append(compare(pa.Table.from_batches(held), *key[1:], cosine, kind))
                    held = []
                held.append(batch.slice(lo, hi - lo))
                key = now
            columns = [np.concatenate(x) for x in zip(*found)] if found else []
            if len(columns) and len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["node", "n", "to"])
        if held:
            last = compare(pa.Table.from_batches(held), *key[1:], cosine, kind)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in last], ["node", "n", "to"])

    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(run, "node long, n long, to long")


def compare(group: pa.Table, leaf: int, i: int, j: int, cosine: float, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each vector of a group: its number, the links first met here, and the smallest vector that it leads to.

    Pairs inside one block belong to the group (i, i); a pair of blocks compares across only.
    """
    nodes = group["node"].to_numpy()
    units = units_of(group["raw"].to_pylist(), kind)
    near = units @ units.T >= cosine
    if i != j:
        block = group["b"].to_numpy()
        near &= block[:, None] != block[None, :]
    a, b = np.divmod(np.flatnonzero(near), len(nodes))
    a, b = a[a < b], b[a < b]
    if not len(a):
        return nodes[:0], nodes[:0], nodes[:0]
    # A link belongs to the first leaf that both vectors are in.
    lists = group["leaves"].combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    flat, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(nodes)), lists.value_lengths().to_numpy())
    ends = np.zeros(len(nodes), bool)
    ends[a] = ends[b] = True
    earlier = (flat < leaf) & ends[owner]
    names, number = np.unique(flat[earlier], return_inverse=True)
    member = np.zeros((len(nodes), len(names)), bool)
    member[owner[earlier], number] = True
    bits, fresh = np.packbits(member, axis=1), np.ones(len(a), bool)
    step = max(1, (1 << 24) // max(1, bits.shape[1]))
    for lo in range(0, len(a), step):
        fresh[lo:lo + step] = ~(bits[a[lo:lo + step]] & bits[b[lo:lo + step]]).any(axis=1)
    weight = group["weight"].to_numpy()
    n = np.zeros(len(nodes), np.int64)
    np.add.at(n, a[fresh], weight[b[fresh]])
    np.add.at(n, b[fresh], weight[a[fresh]])
    label = nodes.copy()
    while True:
        before = label.copy()
        np.minimum.at(label, a, before[b])
        np.minimum.at(label, b, before[a])
        if (label == before).all():
            break
    told = (n > 0) | (label != nodes)
    return nodes[told], n[told], label[told]


def fitted(nodes: DataFrame, cosine: float, settings: Settings, kind: str) -> dict[int, list[Tree]]:
    """The forest of each length, in bytes, that has more vectors than a leaf holds."""
    lengths = nodes.groupBy(F.length("raw").alias("bytes")).count().where(F.col("count") > settings.leaf).orderBy("bytes").collect()
    forests: dict[int, list[Tree]] = {}
    for bytes_, total in lengths:
        most = max(1, min(settings.sample, settings.sample_bytes // len(lengths) // bytes_))
        share = int(min(1.0, most / total) * 1_000_000)
        mine = nodes.where((F.length("raw") == bytes_) & (F.pmod(F.xxhash64("raw"), F.lit(1_000_000)) < share))
        taken = mine.orderBy("node").select("raw").toPandas()
        if not len(taken):
            continue
        sample = units_of(taken["raw"].tolist(), kind)
        forest: list[Tree] = []
        for number in range(settings.trees):
            forest.append(grow(sample, total, cosine, settings, number, max(forest[-1].leaf) + 1 if forest else 0))
        forests[bytes_] = forest
    return forests


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = 0.9,
                    settings: Settings = SETTINGS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; links join vectors of cosine ``cosine`` or more.

    A forest may miss a link whose ends some plane parts in every tree; it never reports one below the
    threshold.  Equal vectors are one node with a weight, so that copies are not paired.  Vectors that
    are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different
    lengths do not link with each other.  Different vectors that share an id are one node, whose links add up.
    Rows with a null id get a null component and are not kept, but count as links.
    """
    kind = number_kind(vectors, embedding)
    rows = cut_lineage(classes(vectors, vec_id, embedding, kind))
    alone = F.col("raw").isNull()
    nodes = cut_lineage(rows.where(~alone).groupBy("raw").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
                        .withColumn("node", F.coalesce("least", F.xxhash64("raw"))))
    forests = fitted(nodes, cosine, settings, kind)
    placed = leaved(nodes, forests, kind)
    met = cut_lineage(compared(grouped(placed, settings.block), cosine, kind))
    links = met.groupBy("node").agg(F.sum("n").alias("n"))
    comps = components(met.select(F.col("node").alias("a"), F.col("to").alias("b")))
    named = nodes.join(links, "node", "left").join(comps, "node", "left").select(
        "raw", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    result = rows.where(alone).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    result = result.union(rows.where(~alone).join(named, "raw").select("vec_id", "n_links", "component_id"))
    component = F.when(F.col("vec_id").isNotNull(), F.col("component_id"))
    return result.select("vec_id", "n_links", component.alias("component_id"),
                         F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), u AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a, u b
  WHERE a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
), reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM v
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen
), comps AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node
), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT c.node AS vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, c.node = component_id AS kept
FROM comps c LEFT JOIN counts ON a = c.node
"""


@query("op1_embeddings", SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))

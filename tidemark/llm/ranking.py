"""Ranked lexical search by Block-Max MaxScore.

The index holds shards of documents.  A shard keeps a list of postings per term, cut into blocks of
``BLOCK`` postings that are packed in as few bytes as they need; beside each block stand its last
document, its largest term count and its shortest document, from which the block's largest possible
score follows once the statistics of the corpus are known.

A query orders its lists by their bounds.  The lists whose bounds together stay below the tenth best
score so far are non-essential: a document found in them alone cannot enter.  The essential lists
are added up; each candidate then meets the non-essential ones, best bound first, and is given up as
soon as its score, the bound of the block it would be in and the bounds of the lists left stay below
the tenth best.  Only blocks of candidates that remain are unpacked.  Shards are searched apart and
their heaps merged.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import rows_of, table, text_bytes
from tidemark.llm.registry import query
from tidemark.session import cut_lineage

BLOCK = 128
#: A shard is closed at this many postings or documents.
SHARD_POSTINGS, SHARD_DOCS = 1 << 21, 1 << 16
#: Documents that a query looks at together, and queries (and characters of queries) that are searched together.
RANGE, QUERIES, QUERY_CHARS = 1 << 13, 2_000, 1 << 24
TOP = 10
#: Bytes of terms stay (A-Z as a-z), all others part terms.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

INDEX = ("shard long, term binary, n long, last array<int>, tf array<int>, shortest array<int>, start array<int>, "
         "packed binary, doc_ids array<long>, lengths array<int>")
INDEX_NAMES = [c.split()[0] for c in INDEX.split(", ")]


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(TERMS).split()


class Numbers(dict):
    """Terms by the number of their first appearance."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


class Shard:
    def __init__(self) -> None:
        self.numbers, self.terms, self.tfs = Numbers(), array("i"), array("i")
        self.doc_ids, self.lengths, self.distinct = [], array("i"), array("i")

    def add(self, doc_id: int | None, raw: bytes) -> None:
        words = terms_of(raw)
        counts = Counter(words)
        self.terms.extend(map(self.numbers.__getitem__, counts))
        self.tfs.extend(counts.values())
        self.doc_ids.append(doc_id)
        self.lengths.append(len(words))
        self.distinct.append(len(counts))

    def full(self) -> bool:
        return len(self.terms) >= SHARD_POSTINGS or len(self.doc_ids) >= SHARD_DOCS

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        """A row for the documents, then one per term in the order of the terms."""
        lengths = np.array(self.lengths, np.int32)
        documents = [number, None, None, None, None, None, None, None, self.doc_ids, lengths]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(documents, INDEX_TYPES)], INDEX_NAMES)
        if not self.numbers:
            return
        names = list(self.numbers)
        place = np.empty(len(names), np.int32)
        in_order = sorted(range(len(names)), key=names.__getitem__)
        place[in_order] = np.arange(len(names), dtype=np.int32)
        term = place[np.array(self.terms, np.int32)]
        order = np.argsort(term, kind="stable")
        docs = np.repeat(np.arange(len(lengths), dtype=np.int32), np.array(self.distinct, np.int32))[order]
        tfs = np.array(self.tfs, np.int32)[order]
        n = np.bincount(term, minlength=len(names))
        blocks = pack(docs, tfs, lengths[docs], n)
        ends = np.concatenate([[0], np.cumsum(blocks["count"])]).astype(np.int32)
        at = np.concatenate([[0], blocks["end"]])[ends].astype(np.int32)
        # The start of a block counts from the beginning of its own list.
        start = (np.concatenate([[0], blocks["end"][:-1]]) - np.repeat(at[:-1], blocks["count"])).astype(np.int32)
        offsets = pa.array(ends)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (blocks["last"], blocks["tf"], blocks["shortest"], start)]
        packed = pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(blocks["bytes"].tobytes())])
        columns = [pa.array(np.full(len(names), number)), pa.array([names[i] for i in in_order], pa.binary()), pa.array(n.astype(np.int64)), *lists, packed,
                   pa.nulls(len(names), INDEX_TYPES[8]), pa.nulls(len(names), INDEX_TYPES[9])]
        yield pa.RecordBatch.from_arrays(columns, INDEX_NAMES)


_INTS = pa.list_(pa.int32())
INDEX_TYPES = [pa.int64(), pa.binary(), pa.int64(), _INTS, _INTS, _INTS, _INTS, pa.binary(), pa.list_(pa.int64()), _INTS]


def width(largest: np.ndarray) -> np.ndarray:
    """Bytes that numbers up to ``largest`` take."""
    return np.where(largest < 1 << 8, 1, np.where(largest < 1 << 16, 2, 4)).astype(np.int64)


def pack(docs: np.ndarray, tfs: np.ndarray, lengths: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Blocks of all lists, one after the other: two width bytes, steps between documents, term counts."""
    list_start = np.repeat(np.cumsum(n) - n, n)
    inside = np.arange(len(docs)) - list_start
    first = np.flatnonzero(inside % BLOCK == 0)
    size = np.diff(np.append(first, len(docs)))
    block = np.repeat(np.arange(len(first)), size)
    before = np.concatenate([[0], docs[:-1]])
    before[inside == 0] = 0
    step = (docs - before).astype(np.int64)
    step[first] = docs[first]  # a block can be read without the ones before it
    w_step, w_tf = width(np.maximum.reduceat(step, first)), width(np.maximum.reduceat(tfs, first))
    end = np.cumsum(2 + size * (w_step + w_tf))
    start = np.concatenate([[0], end[:-1]])
    out = np.zeros(int(end[-1]), np.uint8)
    out[start], out[start + 1] = w_step, w_tf
    number = np.arange(len(docs)) - first[block]
    for values, w, base in ((step, w_step, start + 2), (tfs.astype(np.int64), w_tf, start + 2 + size * w_step)):
        at, wide = base[block] + number * w[block], w[block]
        for k in range(4):
            some = wide > k
            out[at[some] + k] = values[some] >> 8 * k & 255
    return {"count": np.ceil(n / BLOCK).astype(np.int64), "last": docs[first + size - 1].astype(np.int32),
            "tf": np.maximum.reduceat(tfs, first).astype(np.int32), "shortest": np.minimum.reduceat(lengths, first).astype(np.int32),
            "bytes": out, "end": end}


def unpack(packed: bytes, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, term counts) of one block."""
    a, b = packed[start], packed[start + 1]
    size = (end - start - 2) // (a + b)
    docs = np.cumsum(np.frombuffer(packed, f"<u{a}", size, start + 2), dtype=np.int64)
    return docs, np.frombuffer(packed, f"<u{b}", size, start + 2 + size * a).astype(np.int64)


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of all documents: a row per shard with its documents, and one per shard and term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 32, Shard()
        for _, c in rows_of(batches):
            for one, raw in zip(c["doc_id"], c["raw"]):
                shard.add(one, raw)
                if shard.full():
                    yield from shard.rows(number)
                    number, shard = number + 1, Shard()
        if shard.doc_ids:
            yield from shard.rows(number)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text)).mapInArrow(run, INDEX)


def impact(tf, m8):
    return 1_000_000_000 * tf // (1000 * tf + m8)


class Postings:
    """A list of one shard: bounds of its blocks, and what has been unpacked so far."""

    def __init__(self, row: dict, norm) -> None:
        self.last, self.start = np.array(row["last"], np.int64), [*row["start"], len(row["packed"])]
        self.packed, self.kept = row["packed"], {}
        self.bounds = impact(np.array(row["tf"], np.int64), norm(np.array(row["shortest"], np.int64)))
        self.bound = int(self.bounds.max())

    def block(self, i: int, m8: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.kept:
            docs, tf = unpack(self.packed, self.start[i], self.start[i + 1])
            self.kept[i] = docs, impact(tf, m8[docs])
        return self.kept[i]


def search_shard(lists: list[tuple[int, Postings]], m8: np.ndarray, ids: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the best of one shard, ties by ``ids``; ``lists`` are (weight, postings)."""
    lists = sorted((x for x in lists if x[0] > 0), key=lambda x: x[0] * x[1].bound)
    below = np.cumsum([0, *(w * p.bound for w, p in lists)])  # below[j]: bounds of the first j lists together
    best, scored, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
    for lo in range(0, len(m8) if lists else 0, RANGE):
        hi = min(lo + RANGE, len(m8))
        essential = int(np.searchsorted(below[1:], least))  # lists before it stay below the least score
        if essential == len(lists):
            break
        total = np.zeros(hi - lo, np.int64)
        for w, p in lists[essential:]:
            for i in range(int(np.searchsorted(p.last, lo)), min(int(np.searchsorted(p.last, hi - 1)) + 1, len(p.last))):
                docs, gain = p.block(i, m8)
                if docs[0] < lo or docs[-1] >= hi:
                    a, b = np.searchsorted(docs, [lo, hi])
                    docs, gain = docs[a:b], gain[a:b]
                total[docs - lo] += w * gain
        found = np.flatnonzero(total)
        score, found = total[found], found + lo
        for j in range(essential - 1, -1, -1):
            stays = score + below[j + 1] >= least
            found, score = found[stays], score[stays]
            if not len(found):
                break
            w, p = lists[j]
            block = np.searchsorted(p.last, found)
            inside = block < len(p.last)
            bound = np.where(inside, w * p.bounds[np.minimum(block, len(p.last) - 1)], 0)
            stays = score + bound + below[j] >= least
            found, score, block, inside = found[stays], score[stays], block[stays], inside[stays]
            for i in np.unique(block[inside]).tolist():
                docs, gain = p.block(i, m8)
                of = slice(*np.searchsorted(block, [i, i + 1]))
                at = np.minimum(np.searchsorted(docs, found[of]), len(docs) - 1)
                score[of] += np.where(docs[at] == found[of], w * gain[at], 0)
        stays = score >= least
        best, scored = np.concatenate([best, found[stays]]), np.concatenate([scored, score[stays]])
        if len(best) > top:
            order = np.lexsort((ids[best], -scored))[:top]
            best, scored = best[order], scored[order]
        if len(best) == top:
            least = max(1, int(scored.min()))
    return best, scored


def statistics(index: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms of all documents)."""
    lengths = F.col("lengths")
    row = index.where("term IS NULL").agg(
        F.sum(F.size(F.filter(lengths, lambda x: x > 0)).cast("long")).alias("n"),
        F.sum(F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)).alias("total")).first()
    return row.n or 0, row.total or 0


def query_blocks(queries: DataFrame, key: str, text: str) -> Iterator[list[tuple[int | None, Counter]]]:
    """The queries as (key, terms with their number), as many at a time as the limits allow."""
    block, chars = [], 0
    for row in queries.select(F.col(key).cast("long").alias("k"), text_bytes(text)).toLocalIterator():
        block.append((row.k, Counter(terms_of(bytes(row.raw)))))
        chars += len(row.raw)
        if len(block) == QUERIES or chars > QUERY_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def search(index: DataFrame, queries: DataFrame, key: str = "item_id", text: str = "text", top: int = TOP) -> DataFrame:
    """(key, rank, doc_id, score): the best ``top`` documents of every query with a score above 0.

    ``index`` is a stored table of ``build_index``.  Equal scores go by ascending doc_id, nulls last, ranks
    are unique.  Every row of the documents is a document of its own, so repeated rows rank beside each
    other, and every row of the queries is a query, so a key that occurs twice is answered twice.  Null
    and empty texts have no terms: they are never found, and such queries find nothing.
    """
    spark = index.sparkSession
    n_docs, n_terms = statistics(index)
    answers = None
    for number, block in enumerate(query_blocks(queries, key, text)):
        wanted = sorted({t for _, terms in block for t in terms})
        # Bounded by what a block of queries holds.
        asked = spark.createDataFrame([(bytearray(t),) for t in wanted] or [], "asked binary")
        lists = cut_lineage(index.join(F.broadcast(asked), F.col("term") == F.col("asked"), "left_semi"))
        found = {bytes(r.term): r.df for r in lists.groupBy("term").agg(F.sum("n").alias("df")).toLocalIterator()}
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t, df in found.items()}
        shared = spark.sparkContext.broadcast([(i, [(t, c * weights[t]) for t, c in terms.items() if t in weights]) for i, (_, terms) in enumerate(block)])

        def run(group: pa.Table) -> pa.Table:
            rows = {"shard": [], "q": [], "doc_id": [], "score": []}
            postings, shard, m8, ids, doc_ids = {}, None, None, None, None
            head = [r for r in group.filter(pa.compute.is_null(group["term"])).to_pylist()]
            for r in head:
                shard, doc_ids = r["shard"], r["doc_ids"]
                m8 = norm(np.array(r["lengths"], np.int64))
                named = np.array([d for d in doc_ids if d is not None], np.int64)
                # Places in the order of ids, nulls last.
                ids = np.full(len(doc_ids), len(doc_ids), np.int64)
                ids[[i for i, d in enumerate(doc_ids) if d is not None]] = np.unique(named, return_inverse=True)[1]
            for r in group.filter(pa.compute.is_valid(group["term"])).to_pylist():
                postings[r["term"]] = Postings(r, norm)
            for q, terms in shared.value:
                docs, scores = search_shard([(w, postings[t]) for t, w in terms if t in postings], m8, ids, top)
                rows["shard"] += [shard] * len(docs)
                rows["q"] += [q] * len(docs)
                rows["doc_id"] += [doc_ids[d] for d in docs.tolist()]
                rows["score"] += scores.tolist()
            return pa.table({c: pa.array(v, pa.int64()) for c, v in rows.items()})

        def norm(length: np.ndarray) -> np.ndarray:
            return 8 * (100 - 75 + 75 * length * n_docs // max(1, n_terms))

        heads = index.where("term IS NULL").join(F.broadcast(lists.select("shard").distinct()), "shard", "left_semi")
        heaps = lists.unionByName(heads).groupBy("shard").applyInArrow(run, "shard long, q long, doc_id long, score long")
        order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "shard")
        merged = heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        keys = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(block)], f"q long, {key} long")
        part = merged.join(F.broadcast(keys), "q").select(key, "rank", "doc_id", "score")
        answers = part if answers is None else answers.unionByName(part)
    if answers is None:
        return spark.createDataFrame([], f"{key} long, rank int, doc_id long, score long")
    return answers


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL_TERMS = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {SQL_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({SQL_TERMS}) AS term FROM benchmark) GROUP BY ALL),
sizes AS (SELECT CAST(count(*) FILTER (len(terms) > 0) AS BIGINT) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM docs),
postings AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM postings, sizes GROUP BY term, n_docs),
scored AS (SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term), sizes GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= {TOP}"""


@query("op11_ranking", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(cut_lineage(build_index(table(spark, sf_dir, "documents"))), table(spark, sf_dir, "benchmark"))

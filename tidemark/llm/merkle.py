"""Document fingerprints: a Merkle tree over paragraphs and sections.

A paragraph is a line; its leaves are runs of ``RUN`` words.  A section is a stretch of paragraphs
that ends after an empty line or after a paragraph whose hash says so, so that a paragraph put in
moves no other section's edge.  Node hashes cover the hashes below them; equal roots mean equal
texts, and descending only where hashes differ leads to the edits.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import rows_of, table, text_bytes
from tidemark.llm.registry import query

RUN = 4
#: One paragraph in so many ends a section.
SECTION = 8
#: Ranges of ids per shuffle partition; each is one sorted stretch of a task.
RANGES = 4

Tree = tuple[str, list[list[list[str]]]]


#: Node hashes are written with other letters than leaves, so that leaves can be told apart.
NODE = str.maketrans("0123456789abcdef", "ghijklmnopqrstuv")
#: Characters of a section's and of a paragraph's hash in a fingerprint.
SECTION_HASH, PARAGRAPH_HASH = 16, 8


def digest_of(level: bytes, *below: bytes) -> bytes:
    return hashlib.blake2b(b"".join(below), digest_size=16, person=level).digest()


def tree(raw: bytes) -> Tree:
    """(root, sections of paragraphs of leaf hashes, each section and paragraph after its own hash).

    A leaf hashes its words, a paragraph its leaves, a section its paragraphs; the root is a SHA-256 over the sections.
    """
    sections: list[list[list[str]]] = [[]]
    upper, below = hashlib.sha256(), []

    def close() -> None:
        node = digest_of(b"section", *below)
        upper.update(node)
        sections[-1].insert(0, [node.hex()[:SECTION_HASH].translate(NODE)])
        below.clear()

    for line in raw.split(b"\n"):
        words = line.split(b" ")
        leaves = [digest_of(b"leaf", b" ".join(words[i:i + RUN])) for i in range(0, len(words), RUN)] if line else []
        digest = digest_of(b"paragraph", *leaves)
        below.append(digest)
        sections[-1].append([digest.hex()[:PARAGRAPH_HASH].translate(NODE), *[x.hex()[:8] for x in leaves]])
        if not line or digest[0] % SECTION == 0:
            close()
            sections.append([])
    if sections[-1]:
        close()
    else:
        sections.pop()
    return upper.hexdigest(), sections


def written(t: Tree) -> str:
    """The tree as a string: root, then sections apart by ``;``, in each its hash and its paragraphs apart by ``,``.

    A paragraph is its hash and its leaves of eight characters each.
    """
    return t[0] + "=" + ";".join(",".join("".join(p) for p in section) for section in t[1])


def nodes(fingerprint: str) -> tuple[str, list[tuple[str, list[str]]]]:
    """The root, and of every section its hash and those of its paragraphs."""
    root, _, rest = fingerprint.partition("=")
    split = [s.split(",") for s in rest.split(";")]
    return root, [(s[0], [p[:PARAGRAPH_HASH] for p in s[1:]]) for s in split]


def parsed(fingerprint: str) -> Tree:
    """The root, and sections of paragraphs of leaves without the hashes above them."""
    root, _, rest = fingerprint.partition("=")
    leaves = [[[p[i:i + 8] for i in range(PARAGRAPH_HASH, len(p), 8)] for p in s.split(",")[1:]] for s in rest.split(";")]
    return root, leaves


def likeness(a: str, b: str) -> float:
    """Leaves that two fingerprints share, of all that they have, between 0 and 1; 1 if and only if the roots are equal."""
    if a[:64] == b[:64]:
        return 1.0
    left, right = Counter(re.findall("[0-9a-f]{8}", a[65:])), Counter(re.findall("[0-9a-f]{8}", b[65:]))
    shared = (left & right).total()
    total = left.total() + right.total()
    return min(2 * shared / total, 1 - 1e-9) if total else 0.0


def edits(a: str, b: str) -> list[tuple[int, int, str]]:
    """(section, paragraph, side) places at which ``b`` differs from ``a``, in order; only differing sections are opened.

    Side ``new``: a paragraph of ``b`` that is put in, or put in the place of one of ``a``.  Side ``old``: one of
    ``a`` that is gone, nothing being in its place.  A paragraph that moved is gone in ``a`` and put in in ``b``.
    """
    (root_a, old), (root_b, new) = nodes(a), nodes(b)
    if root_a == root_b:
        return []
    found = []
    for how, i, k, j, m in SequenceMatcher(None, [s[0] for s in old], [s[0] for s in new], False).get_opcodes():
        if how == "equal":
            continue
        left = [(x, at, p) for x in range(i, k) for at, p in enumerate(old[x][1])]
        right = [(x, at, p) for x in range(j, m) for at, p in enumerate(new[x][1])]
        for kind, c, d, e, f in SequenceMatcher(None, [p[2] for p in left], [p[2] for p in right], False).get_opcodes():
            if kind != "equal":
                found += [(x, at, "new") for x, at, _ in right[e:f]]
                found += [(x, at, "old") for x, at, _ in left[c + f - e:d]]
    return found


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every whole text; a null text counts as empty."""

    @F.pandas_udf("string")
    def run(raws: pd.Series) -> pd.Series:
        return pd.Series([written(tree(raw)) for raw in raws], dtype="object")

    return docs.select(F.col(doc_id).alias("doc_id"), run(text_bytes(text)).alias("fingerprint"))


def located_edits(pairs: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """``pairs`` of fingerprints with ``edits`` array<struct<section, paragraph, side>>; null where one of them is null."""

    @F.pandas_udf("array<struct<section:int,paragraph:int,side:string>>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else [{"section": i, "paragraph": j, "side": s} for i, j, s in edits(x, y)]
                          for x, y in zip(a, b)], dtype="object")

    return pairs.withColumn("edits", run(F.col(old), F.col(new)))


def in_order(docs: DataFrame) -> DataFrame:
    """(part, ahead, doc_id, raw): texts dealt to ranges of ids, each range followed by the first row of the next.

    ``ahead`` marks the row that follows a range.  Edges are estimated quantiles that exist as ids; each
    text is shuffled once.
    """
    spark = docs.sparkSession
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    shares = [i / n for i in range(1, n)]
    bounds = ids.agg(F.min("doc_id").alias("low"), F.percentile_approx("doc_id", shares, 4 * n).alias("at"),
                     F.max(F.col("doc_id").isNull()).alias("nulls")).first()
    # The edges are a fixed number of ids for each partition.
    edges = sorted({x for x in [bounds.low, *(bounds.at or [])] if x is not None})
    first = np.array(edges, np.int64)
    last = len(edges) if bounds.nulls else len(edges) - 1
    parts = max(1, last + 1)

    @F.pandas_udf("array<int>")
    def homes(values: pd.Series, missing: pd.Series) -> pd.Series:
        """The range of an id; for the first id of a range also the range before, as -1 - that."""
        ids, none = values.to_numpy(np.int64), missing.to_numpy(bool)
        home = np.where(none, last, np.searchsorted(first, ids, "right") - 1)
        leads = none.copy()
        leads[~none] = first[home[~none]] == ids[~none]
        return pd.Series([[h, -1 - (h - 1) % parts] if lead else [h] for h, lead in zip(home.tolist(), leads.tolist())], dtype="object")

    key = F.col("doc_id").cast("long")
    home = homes(F.coalesce(key, F.lit(0)), key.isNull())
    dealt = docs.select(key.alias("doc_id"), text_bytes(), F.explode(home).alias("home"))
    ahead = F.col("home") < 0
    return dealt.select(F.when(ahead, -1 - F.col("home")).otherwise(F.col("home")).alias("part"), ahead.alias("ahead"), "doc_id", "raw")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has its last floor(n_chars / 2) code points replaced by as many (or all) first ones
    of the next document's text; ids ascend, a null id comes last, rows that share an id go by their
    text, and the first document follows the last.  A single document follows itself.  Null texts
    count as empty.  Empty tables give no rows.
    """

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays(columns, names)

    def digest(doc_id, raw: bytes, mine: str, after: bytes, theirs: str) -> tuple:
        text = raw.decode()
        half = len(text) // 2
        edited = (text[:len(text) - half] + after.decode()[:half]).encode()
        changed = written(tree(edited))
        return (doc_id, len(text), hashlib.sha256(edited).hexdigest(), mine, changed, likeness(mine, changed), likeness(mine, theirs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, out = None, []
        for _, c in rows_of(batches):
            for part, ahead, doc_id, raw in zip(c["part"], c["ahead"], c["doc_id"], c["raw"]):
                mine = written(tree(raw))
                if before is not None and before[0] == part:
                    out.append(digest(*before[1:], raw, mine))
                before = None if ahead else (part, doc_id, raw, mine)
                if len(out) >= 256:
                    yield flush(out)
                    out = []
        if out:
            yield flush(out)

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = in_order(docs).repartition(n, "part").sortWithinPartitions("part", "ahead", F.col("doc_id").asc_nulls_last(), "raw")
    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                "edited_fingerprint string, near_edited double, near_next double")


@query("op2_merkle")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))

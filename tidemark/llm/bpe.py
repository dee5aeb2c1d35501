"""BPE encoding and decoding with forced boundaries.

Two bytes that stand side by side in no vocabulary token can never end up in one token, so that a
word is cut between them before any merge is looked for.  The fragments are encoded on their own
and their ids put together.  Words and fragments recur, hence each worker keeps what it has
encoded, up to a fixed number of entries.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import rows_of, table, text_bytes
from tidemark.llm.registry import query

#: Entries that a worker keeps; beyond them it encodes anew, so memory stays bounded.
KEPT_WORDS, KEPT_FRAGMENTS, KEPT_LENGTH = 300_000, 20_000, 64
#: Symbols up to which a fragment's ranks are searched through instead of queued.
SHORT = 48
#: The end of a word, which belongs to the last symbol of its last fragment.
END = "</w>"
#: Separators that Python splits at but Unicode does not call white space.
CONTROL = re.compile("[\x1c-\x1f]")
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


def byte_symbols() -> list[str]:
    """A printable character for each byte: itself where printable, else the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [c for _, c in sorted([(b, chr(b)) for b in plain] + [(b, chr(0x100 + i)) for i, b in enumerate(rest)])]


class Encoder:
    """Encodes and decodes with the tables of one tokenizer file (words with an end mark, no special tokens added)."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.ids.items()}
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(split["pattern"]["Regex"])
        self.symbols = byte_symbols()
        self.touching = {pair for t in self.ids for pair in zip(t.removesuffix(END), t.removesuffix(END)[1:])}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.added.items()}
        self.marks = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or "(?!)")
        self.kept_words: dict[str, tuple[str, int, str]] = {}
        self.kept_fragments: dict[str, list[int]] = {}

    def fragments(self, word: str) -> Iterator[str]:
        """The word's symbols cut wherever two neighbours touch in no token; the last ends in the end mark."""
        line = "".join([self.symbols[b] for b in word.encode()])
        start, touching = 0, self.touching
        for at, pair in enumerate(zip(line, line[1:]), 1):
            if pair not in touching:
                yield line[start:at]
                start = at
        yield line[start:] + END

    def merged(self, fragment: str) -> list[int]:
        """Ids of a fragment: the pair of lowest rank merges first, the leftmost of equals."""
        known = self.kept_fragments.get(fragment)
        if known is not None:
            return known
        parts = list(fragment.removesuffix(END))
        if fragment.endswith(END):
            parts[-1] += END
        found = [self.ids[p] for p in (self.merge_short(parts) if len(parts) <= SHORT else self.merge_long(parts))]
        if len(self.kept_fragments) < KEPT_FRAGMENTS and len(fragment) <= KEPT_LENGTH:
            self.kept_fragments[fragment] = found
        return found

    def merge_short(self, parts: list[str]) -> list[str]:
        """Merges by looking through all ranks each time, which is fastest for a word."""
        rank_of, never = self.ranks.get, len(self.ranks)
        ranks = [rank_of(p, never) for p in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < never:
            i = ranks.index(least)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of((parts[i - 1], parts[i]), never)
            if i < len(ranks):
                ranks[i] = rank_of((parts[i], parts[i + 1]), never)
        return parts

    def merge_long(self, parts: list[str | None]) -> list[str]:
        """The same order of merges from a queue, for fragments of any length."""
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(self.ranks[p], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in self.ranks]
        heapq.heapify(queue)
        while queue:
            _, i, (left, right) = heapq.heappop(queue)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue
            parts[i], parts[j], after[i] = left + right, None, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (rank := self.ranks.get(pair := (parts[k], parts[after[k]]))) is not None:
                    heapq.heappush(queue, (rank, k, pair))
        return [p for p in parts if p is not None]

    def spaced(self, chunk: str) -> tuple[str, int, str]:
        """A piece of text without white space: its ids and its tokens, both joined by spaces, and their number."""
        words = [chunk] if chunk.isascii() and chunk.isalpha() else self.word.findall(chunk)
        found = [i for word in words for part in self.fragments(word) for i in self.merged(part)]
        entry = " ".join(map(str, found)), len(found), " ".join([self.tokens[i] for i in found])
        if len(self.kept_words) < KEPT_WORDS and len(chunk) <= KEPT_LENGTH:
            self.kept_words[chunk] = entry
        return entry

    def entries(self, text: str) -> list[tuple[str, int, str]]:
        found, at = [], 0
        for mark in self.marks.finditer(text):
            found += [*self.plain(text[at:mark.start()]), (str(self.added[mark[0]]), 1, mark[0])]
            at = mark.end()
        return [*found, *self.plain(text[at:])] if at else self.plain(text)

    def plain(self, text: str) -> list[tuple[str, int, str]]:
        text = unicodedata.normalize("NFC", text)
        # Every character is lower-cased on its own: a sigma does not depend on its place.
        text = "".join([c.lower() for c in text]) if "Σ" in text else text.lower()
        chunks = [c for c in SPACE.split(text) if c] if CONTROL.search(text) else text.split()
        kept = self.kept_words
        return [kept.get(c) or self.spaced(c) for c in chunks]

    def encode(self, text: str) -> list[int]:
        return [int(i) for e in self.entries(text) if e[1] for i in e[0].split(" ")]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.tokens[i] for i in ids])

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, and SHA-256 of the ids and of the text they decode to."""
        found = [e for e in self.entries(text) if e[1]]
        ids, tokens = " ".join([e[0] for e in found]), " ".join([e[2] for e in found])
        return sum(e[1] for e in found), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(tokens.encode()).hexdigest()


#: One encoder per worker process and tokenizer, so that tasks share what it has kept.
ENCODERS: dict[str, Encoder] = {}


def encoder_of(spec: bytes) -> Encoder:
    key = hashlib.sha256(spec).hexdigest()
    if key not in ENCODERS:
        ENCODERS[key] = Encoder(json.loads(spec))
    return ENCODERS[key]


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_spec(spark: SparkSession, path: str | None):
    """The tokenizer file, read by the driver and broadcast: its size is that of a vocabulary, whatever the data."""
    with open(path or public_path(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encoded(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): token ids of every whole text; none for null, empty and blank texts."""
    spec = shared_spec(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(spec.value)
        for batch, c in rows_of(batches):
            ids = pa.array([encoder.encode(x.decode()) for x in c["raw"]], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).alias("doc_id"), text_bytes(text)).mapInArrow(
        run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, ids array<int>")


def decoded(ids: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, decoded string): the tokens of ``encoded`` rows, joined by a space; null ids count as none."""
    spec = shared_spec(ids.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(spec.value)
        for batch, c in rows_of(batches):
            texts = pa.array([encoder.decode(x or []) for x in c["ids"]], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "decoded"])

    return ids.select("doc_id", "ids").mapInArrow(
        run, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, decoded string")


def digests(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row; a null text counts as empty."""
    spec = shared_spec(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(spec.value)
        for batch, c in rows_of(batches):
            found = list(zip(*[encoder.digest(x.decode()) for x in c["raw"]])) or [[], [], []]
            columns = [batch.column(0), pa.array(found[0], pa.int64()), pa.array(found[1], pa.string()),
                       pa.array(found[2], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), text_bytes(text)).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query("op5_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))

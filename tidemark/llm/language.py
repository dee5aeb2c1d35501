"""Language identification with word-first backoff.

A known word counts with the logarithm of its frequency in each language.  An unknown word is read
from its beginning as the longest known character n-grams, ever shorter ones where none fits.

The model is fitted on a bounded sample of labelled rows (``Settings.per_language``); every whole text
is scored with it.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, rows_of, table, text_bytes
from tidemark.llm.registry import query
from tidemark.session import cut_lineage

UNDETERMINED = "und"
WORDS = regex.compile(r"\p{L}+")


@dataclass(frozen=True)
class Settings:
    """Bounds of the model; none of them limits which texts or words are scored."""

    per_language: int = 5_000  # labelled documents of a language to fit on, in the order of a hash of their ids
    words: int = 100_000  # known words
    grams: int = 200_000  # known character n-grams
    longest: int = 5
    smoothing: float = 0.5


SETTINGS = Settings()
#: Distinct words that a task counts at a time, and that a worker keeps.
COUNTED, KEPT = 200_000, 400_000


def words_of(raw: bytes) -> list[str]:
    return WORDS.findall(unicodedata.normalize("NFC", raw.decode()).lower())


def grams_of(word: str, longest: int) -> Iterator[str]:
    """Its n-grams, with a mark at either end; the marks alone are none."""
    line = f"^{word}$"
    for n in range(1, longest + 1):
        for i in range(n == 1, len(line) - n + 1 - (n == 1)):
            yield line[i:i + n]


def counted(rows: DataFrame, run) -> DataFrame:
    """(lang, item, n) summed over what the tasks counted."""
    return rows.mapInArrow(run, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n"))


def emptied(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    for lang, found in counts.items():
        columns = [pa.array([lang] * len(found)), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "item", "n"])
    counts.clear()


def count_words(sample: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)
        for _, c in rows_of(batches):
            for lang, raw in zip(c["lang"], c["raw"]):
                counts[lang].update(words_of(raw))
            if sum(map(len, counts.values())) > COUNTED:
                yield from emptied(counts)
        yield from emptied(counts)

    return counted(sample, run)


def count_grams(words: DataFrame, longest: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)
        for _, c in rows_of(batches):
            for lang, word, n in zip(c["lang"], c["item"], c["n"]):
                found = counts[lang]
                for gram in grams_of(word, longest):
                    found[gram] += n
            if sum(map(len, counts.values())) > COUNTED:
                yield from emptied(counts)
        yield from emptied(counts)

    return counted(words, run)


def most_frequent(counts: DataFrame, langs: list[str], limit: int) -> dict[str, list[int]]:
    """Counts per language of the items that occur most often, seen twice at least."""
    per = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"c{i}") for i, lang in enumerate(langs)]
    rows = counts.groupBy("item").agg(F.sum("n").alias("total"), *per).where("total > 1")
    found = rows.orderBy(F.desc("total"), "item").limit(limit).toPandas()
    return dict(zip(found["item"], found[[f"c{i}" for i in range(len(langs))]].to_numpy().tolist()))


@dataclass
class Model:
    langs: list[str]
    words: dict[str, list[int]]
    grams: dict[str, list[int]]
    settings: Settings = SETTINGS


def fit(docs: DataFrame, settings: Settings = SETTINGS) -> Model:
    """Word and n-gram counts of a sample of the labelled rows that are not held out."""
    known = docs.where(F.col("lang").isNotNull() & ~held_out()).select("lang", "doc_id", "text")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], {}, {}, settings)
    most = 1_000_000
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(most, most * settings.per_language // sizes[lang]))])
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(most)) < share[F.col("lang")]).select("lang", text_bytes())
    words = cut_lineage(count_words(sample))
    return Model(langs, most_frequent(words, langs, settings.words),
                 most_frequent(count_grams(words, settings.longest), langs, settings.grams), settings)


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}
        self.vectors = np.zeros((len(model.words) + KEPT, max(1, len(model.langs))))
        if model.words:
            self.vectors[:len(model.words)] = self.logs(np.array(list(model.words.values()), float))
            self.known = {w: i for i, w in enumerate(model.words)}
        self.grams: dict[str, np.ndarray] = {}
        for n in range(1, model.settings.longest + 1):
            same = {g: c for g, c in model.grams.items() if len(g) == n}
            if same:
                self.grams.update(zip(same, self.logs(np.array(list(same.values()), float))))

    def logs(self, counts: np.ndarray) -> np.ndarray:
        a = self.model.settings.smoothing
        return np.log((counts + a) / (counts.sum(axis=0) + a * len(counts)))

    def backoff(self, word: str) -> np.ndarray:
        line, i = f"^{word}$", 0
        total = np.zeros(self.vectors.shape[1])
        while i < len(line):
            for n in range(min(self.model.settings.longest, len(line) - i), 0, -1):
                found = self.grams.get(line[i:i + n])
                if found is not None:
                    total += found
                    break
            i += n
        return total

    def predict(self, raw: bytes) -> tuple[str, float]:
        words = Counter(words_of(raw))
        if not words or not self.model.langs:
            return UNDETERMINED, 0.0
        rows, times, total = [], [], np.zeros(self.vectors.shape[1])
        for word, n in words.items():
            at = self.known.get(word)
            if at is None:
                vector = self.backoff(word)
                if len(self.known) < len(self.vectors) and len(word) <= 64:
                    self.vectors[len(self.known)] = vector
                    self.known[word] = len(self.known)
                total += n * vector
            else:
                rows.append(at)
                times.append(n)
        total += np.array(times, float) @ self.vectors[rows] if rows else 0
        odds = np.exp(total - total.max())
        best = int(odds.argmax())
        return self.model.langs[best], float(odds[best] / odds.sum())


#: One scorer per worker process and model.
SCORERS: dict[int, Scorer] = {}


def languages(docs: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row: the likeliest language and its posterior probability.

    ``und`` with score 0 where the text is null or has no letter, or where no labels were learned.
    A text of letters that tells nothing gets the first language in order, at even odds.  Repeated
    rows come back as often as they occur; labels of rows with null ids are learned from.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, settings))
    key = shared._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in SCORERS:
            SCORERS.clear()
            SCORERS[key] = Scorer(shared.value)
        for batch, c in rows_of(batches):
            found = [SCORERS[key].predict(raw) for raw in c["raw"]]
            columns = [batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()),
                       pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), text_bytes()).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


@query("op4_language")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))

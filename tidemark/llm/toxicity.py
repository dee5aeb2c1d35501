"""Toxicity by noisy-channel deobfuscation.

Chunks that are not plain words (digits or signs for letters, letters set apart, letters repeated)
are read as a lattice of characters, and Viterbi decoding under a character trigram model finds the
likeliest plain text.  Words of the restored text then carry evidence from labelled documents.
Words with a doubled letter and neighbouring chunks are decoded too where their folded form (look-alikes
read, signs and repetitions gone) is that of a feature; no other reading of them could carry evidence.

The trigram model counts all documents.  Labels are learned from a bounded sample of labelled rows
(``Settings.labelled``) that are not held out.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, rows_of, table, text_bytes, unused
from tidemark.llm.registry import query
from tidemark.session import cut_lineage, release


@dataclass(frozen=True)
class Settings:
    """Bounds of what is learned; none of them limits which documents or words are scored."""

    labelled: int = 20_000  # labelled rows to fit on, taken in the order of a hash of their ids
    support: int = 50  # words and word beginnings in one of so many toxic texts (two at least) carry evidence
    lift: float = 3.0  # by how much a feature raises the odds of a toxic text, at least
    letters: int = 100_000_000  # a trigram or bigram counts if it stands for one of so many letters of the corpus
    prefixes: tuple[int, ...] = (4, 5, 6, 7)
    smoothing: float = 1.0  # documents that a feature counts as having been seen in before any
    top: int = 3  # words whose evidence enters a document's score


SETTINGS = Settings()

# Letters that digits and signs stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i",
}
#: Log-probabilities of the channel: a look-alike read as its letter, a letter repeated, and what a sign or
#: look-alike costs that means nothing or ends a word.
SWAP, REPEAT = -1.0, -0.5
NOTHING = {True: -12.0, False: -1.0}
ENDING = {True: -12.0, False: -1.0, " ": -4.0}
EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in LOOKALIKES) + "¿…“”‘’«»–—"
TRIPLE = re.compile(r"(.)\1\1")
REPEATED = re.compile(r"(.)\1+")
ACROSS = re.compile(r"(.) \1")
#: Each letter or look-alike as one of its readings, the letters of one look-alike alike; signs go.
FOLDED = str.maketrans({**{c: "" for c in EDGES}, **{c: x[0] for c, x in LOOKALIKES.items()}, "l": "i", "£": "i"})
#: Distinct chunks that a task counts at a time, and that a worker keeps.
COUNTED, KEPT = 200_000, 300_000


def plain(chunk: str) -> str | None:
    """The word in a lower-case chunk whose lattice has one path only, else None."""
    if not chunk.isalpha():
        chunk = chunk.strip(EDGES)
        if chunk and not chunk.isalpha():
            return None
    return None if TRIPLE.search(chunk) else chunk


def chunks_of(raw: bytes) -> list[str]:
    """Lower-case chunks between white space; three or more single characters in a row become one chunk."""
    chunks = raw.decode().lower().split()
    single = [i for i, n in enumerate(map(len, chunks)) if n == 1]
    runs, start = [], 0
    for at in range(1, len(single) + 1):
        if at == len(single) or single[at] != single[at - 1] + 1:
            if at - start >= 3:
                runs.append((single[start], single[at - 1] + 1))
            start = at
    for lo, hi in reversed(runs):
        chunks[lo:hi] = [" ".join(chunks[lo:hi])]
    return chunks


def folded(text: str) -> str:
    return REPEATED.sub(r"\1", text.translate(FOLDED))


class Folds(dict):
    """Chunks in folded form, worked out when first asked for."""

    def __missing__(self, chunk: str) -> str:
        fold = folded(chunk)
        if len(self) < KEPT and len(chunk) <= 64:
            self[chunk] = fold
        return fold


class Lexicon:
    """The features in folded form, and which stretches of neighbouring chunks may hold a word among them."""

    def __init__(self, features: Iterable[str]) -> None:
        self.features = {folded(f.strip()) for f in features}
        self.words = {folded(f.strip()) for f in features if f.endswith(" ")}
        self.kept = Folds()
        self.beginnings = {w[:n] for w in self.words for n in range(1, len(w) + 1)}

    def doubled(self, word: str, prefixes: tuple[int, ...]) -> bool:
        """Whether a word with a doubled letter may stand for one with features."""
        if not REPEATED.search(word):
            return False
        short = folded(word)
        return short in self.words or any(short[:n] in self.features for n in range(2, max(prefixes, default=0) + 1))

    def stretches(self, chunks: list[str]) -> Iterator[str]:
        """Two or more neighbouring chunks, a space between them, that fold to a known word."""
        line, parts = " ".join(chunks), chunks
        if line.count(" ") != len(chunks) - 1:  # a chunk of single characters
            parts = line.split(" ")
        begins, words = self.beginnings, self.words
        short = list(map(self.kept.__getitem__, parts))
        last = len(parts)
        for at in [i for i, fold in enumerate(short) if fold in begins]:
            begin = short[at]
            for end in range(at + 1, last):
                more = short[end]
                if more:
                    begin += more[1:] if more[0] == begin[-1] else more
                    if begin not in begins:
                        break
                    if begin in words:
                        yield " ".join(parts[at:end + 1])


class CharacterModel:
    """P(letter | two before), interpolated with the letter's own frequency; a space stands at both ends of words."""

    def __init__(self, trigrams: dict[str, int], bigrams: dict[str, int] | None = None, letters: dict[str, int] | None = None) -> None:
        self.three, self.two, self.one = trigrams, bigrams or Counter(), letters or Counter()
        for gram, n in trigrams.items() if letters is None else ():
            self.two[gram[:2]] += n
            self.one[gram[2]] += n
        self.total = sum(self.one.values()) + len(self.one) + 1
        self.log, self.joined = lru_cache(1 << 17)(self.log), {}

    def log(self, before: str, letter: str) -> float:
        base = (self.one.get(letter, 0) + 1) / self.total
        return math.log((self.three.get(before + letter, 0) + 5 * base) / (self.two.get(before, 0) + 5))

    def restore(self, chunk: str, repeats: int = 3) -> list[str]:
        """Viterbi path through the chunk's lattice, as words; ``repeats`` equal letters or more may be repetitions.

        A state is the last two letters; each character is a letter, a repetition of the last one, a
        look-alike, a sign without meaning or the end of a word.
        """
        states: dict[str, tuple[float, str]] = {"  ": (0.0, "")}
        runs = [len(m[0]) for m in re.finditer(r"(?s)(.)\1*", chunk) for _ in m[0]]
        for at, (c, run) in enumerate(zip(chunk, runs)):
            letter, after = c.isalpha(), {}
            again = at > 0 and chunk[at - 1] == c and run >= (repeats if letter or repeats > 3 else 2)

            def offer(state: str, score: float, text: str) -> None:
                if state not in after or after[state][0] < score:
                    after[state] = score, text

            for state, (score, text) in states.items():
                for x in c if letter else LOOKALIKES.get(c, ""):
                    cost = score if letter else score + SWAP
                    offer(state[1] + x, cost + self.log(state, x), text + x)
                    if again and x == state[1]:
                        offer(state, score + REPEAT, text)
                if not letter:
                    offer(state, score + NOTHING[c in LOOKALIKES], text)
                    ended = 0.0 if state[1] == " " else self.log(state, " ")
                    offer("  ", score + ENDING.get(c, ENDING[c in LOOKALIKES]) + ended, text + " ")
            states = after
        best = max(states.items(), key=lambda s: (s[1][0] + (0.0 if s[0][1] == " " else self.log(s[0], " ")), s[1][1]))
        return best[1][1].split()

    def readings(self, chunk: str, repeats: int) -> list[str]:
        """Restored words; equal look-alikes in a row are one letter or as many, and both readings count."""
        twice = self.restore(chunk, len(chunk) + 4) if any(m[1] in LOOKALIKES for m in REPEATED.finditer(chunk)) else []
        return [*self.restore(chunk, repeats), *twice]

    def doubled(self, chunk: str, lexicon: Lexicon, prefixes: tuple[int, ...]) -> list[str]:
        """The restored words of a plain chunk with a doubled letter that may stand for a feature."""
        word = plain(chunk)
        return self.restore(word, 2) if word and lexicon.doubled(word, prefixes) else []

    def rejoined(self, chunks: list[str], lexicon: Lexicon) -> set[str]:
        """Restored words across neighbouring chunks, without the words that the chunks are by themselves."""
        found: set[str] = set()
        for stretch in set(lexicon.stretches(chunks)):
            words = self.joined.get(stretch)
            if words is None:
                # A letter repeated on both sides of a gap is a repetition only without the gap.
                whole = self.restore(stretch.replace(" ", ""), 2) if ACROSS.search(stretch) else []
                words = {*self.readings(stretch, 2), *whole}.difference(stretch.split(" "))
                if len(self.joined) < KEPT:
                    self.joined[stretch] = words
            found |= words
        return found

    def words(self, chunk: str) -> list[str]:
        """The chunk's words: itself where plain, else the restored ones and the runs of letters as written."""
        word = plain(chunk)
        if word is not None:
            return [word] if word else []
        if not any(c.isalpha() or c in LOOKALIKES for c in chunk):
            return []
        return list(dict.fromkeys([*self.readings(chunk, 3), *re.findall(r"[^\W\d_]+", chunk)]))


class Spelling:
    """Whether any path through a chunk's lattice spells a feature; where none does, decoding it gives no evidence.

    Features are a trie.  Words begin at the chunk's start or after a character that may end one; a letter
    goes on or repeats the last one, a look-alike is any of its letters or nothing, a sign is nothing.
    """

    def __init__(self, features: Iterable[str]) -> None:
        self.root: dict = {}
        for feature in features:
            node = self.root
            for c in feature.strip():
                node = node.setdefault(c, {})
            node[""] = {}

    def possible(self, chunk: str) -> bool:
        root, before = self.root, ""
        states = {id(root): root}
        for c in chunk:
            letter, after = c.isalpha(), {}
            for state in states.values():
                if not letter or c == before and state is not root:
                    after[id(state)] = state
                for x in c if letter else LOOKALIKES.get(c, ""):
                    to = state.get(x)
                    if to is not None:
                        if "" in to:
                            return True
                        after[id(to)] = to
            if not letter:
                after[id(root)] = root
            states, before = after, c
        return False


def features(word: str, prefixes: tuple[int, ...]) -> list[str]:
    """The word and its beginnings; a space marks a whole word."""
    return [word + " ", *[word[:n] for n in prefixes if n <= len(word)]]


@dataclass
class Model:
    trigrams: dict[str, int]
    weights: dict[str, float]
    coefficients: list[float]
    settings: Settings = SETTINGS
    key: str = field(default="")
    bigrams: dict[str, int] | None = None
    letters: dict[str, int] | None = None


class Reader:
    """Words of chunks that have features among ``known``; what chunks hold is worked out once."""

    def __init__(self, letters: CharacterModel, known: dict, settings: Settings) -> None:
        self.letters, self.known, self.settings = letters, known, settings
        self.lexicon, self.spelling = Lexicon(known), Spelling(known)
        self.kept: dict[str, tuple[list[str], list[str]]] = {}
        self.empty: set[str] = set()

    def telling(self, words: Iterable[str]) -> list[str]:
        prefixes, known = self.settings.prefixes, self.known
        return [w for w in dict.fromkeys(words) if any(f in known for f in features(w, prefixes))]

    def words(self, chunk: str) -> tuple[list[str], list[str]]:
        """(words of a chunk, words that it has only if a doubled letter is a repetition), as far as they have features."""
        entry = self.kept.get(chunk)
        if entry is not None:
            return entry
        word = plain(chunk)
        if word is not None:
            own = self.telling([word])
            twice = self.telling(self.letters.doubled(chunk, self.lexicon, self.settings.prefixes))
        else:
            own = self.letters.words(chunk) if self.spelling.possible(chunk) else re.findall(r"[^\W\d_]+", chunk)
            own, twice = self.telling(own), []
        if len(chunk) <= 64:
            if not own and not twice:
                if len(self.empty) < 2 * KEPT:
                    self.empty.add(chunk)
            elif len(self.kept) < KEPT:
                self.kept[chunk] = own, twice
        return own, twice

    def read(self, raw: bytes) -> tuple[int, set[str], set[str]]:
        """(chunks of a text, its words, words that only repetitions or neighbouring chunks give), as far as they have features."""
        chunks = chunks_of(raw)
        own, more = set(), set()
        for chunk in set(chunks).difference(self.empty):
            a, b = self.words(chunk)
            own.update(a)
            more.update(b)
        more.update(self.telling(self.letters.rejoined(chunks, self.lexicon)))
        return len(chunks), own, more


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.letters = model, CharacterModel(model.trigrams, model.bigrams, model.letters)
        self.reader = Reader(self.letters, model.weights, model.settings)

    def weight(self, word: str) -> float:
        """The largest weight among a word's features."""
        weights = self.model.weights
        return max(weights[f] for f in features(word, self.model.settings.prefixes) if f in weights)

    def score(self, raw: bytes) -> float:
        n_chunks, own, more = self.reader.read(raw)
        return probability(self.model.coefficients, inputs([self.weight(w) for w in own | more], n_chunks, self.model.settings.top))


def inputs(weights: list[float], n_chunks: int, top: int) -> list[float]:
    best = heapq.nlargest(top, weights)
    return [1.0, *best, *[0.0] * (top - len(best)), math.log1p(n_chunks)]


def probability(coefficients: list[float], x: list[float]) -> float:
    z = sum(a * b for a, b in zip(coefficients, x))
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


#: Kinds of characters, by code point; 255 until one is first met.
SPACE, ALPHA, EDGE, OTHER, UNKNOWN = 0, 1, 2, 3, 255
KINDS = np.full(0x110000, UNKNOWN, np.uint8)
#: Characters of texts that are looked at together, and cells of a table of trigrams.
LETTERS_AT_ONCE, TABLE_CELLS = 1 << 20, 1 << 22


def kinds_of(codes: np.ndarray) -> np.ndarray:
    kinds = KINDS[codes]
    if (kinds == UNKNOWN).any():
        for code in np.unique(codes[kinds == UNKNOWN]).tolist():
            c = chr(code)
            KINDS[code] = SPACE if c.isspace() else ALPHA if c.isalpha() else EDGE if c in EDGES else OTHER
        kinds = KINDS[codes]
    return kinds


def count_plain(text: str, grams: Counter) -> None:
    """Add the trigrams of the ``plain`` chunks of a lower-case text, repeats included; a space stands twice before a word and once after it."""
    if len(text) > 2 * LETTERS_AT_ONCE:  # one long chunk: in less memory
        if word := plain(text):
            line = f"  {word} "
            grams.update(line[i:i + 3] for i in range(len(word) + 1))
        return
    # Characters as numbers, white space at both ends, so that every word has neighbours.
    codes = np.frombuffer(f"  {text}  ".encode("utf-32-le"), np.uint32)
    kinds = kinds_of(codes)
    alpha, filled = kinds == ALPHA, kinds != SPACE
    starts = np.flatnonzero(filled[1:] & ~filled[:-1]) + 1
    if not len(starts):
        return
    # A chunk is plain if its letters stand in one run, nothing but edges around them, and none three times in a row.
    faults = np.zeros(len(codes), np.int32)
    faults[1:] = alpha[1:] & ~alpha[:-1]
    faults[kinds == OTHER] = 2
    same = codes[1:] == codes[:-1]
    faults[2:][alpha[2:] & same[1:] & same[:-1]] += 2
    good = np.add.reduceat(faults, starts) == 1
    # From the first chunk on, every character belongs to the chunk that begins at it or before it.
    letter = alpha[starts[0]:] & np.repeat(good, np.diff(np.append(starts, len(codes))))
    codes = codes[starts[0]:]
    alphabet = np.flatnonzero(np.bincount(codes[letter])) if letter.any() else np.zeros(0, np.int64)
    if not len(alphabet):
        return
    names, k = [" ", *map(chr, alphabet.tolist())], len(alphabet) + 1
    number = np.zeros(int(alphabet[-1]) + 1, np.int64)
    number[alphabet] = np.arange(1, k)
    at = np.zeros(len(codes) + 2, np.int64)
    at[2:][letter] = number[codes[letter]]
    third, second = at[2:], at[1:-1]
    wanted = (third > 0) | (second > 0)
    first = np.where(second > 0, at[:-2], 0)
    cells = ((first * k + second) * k + third)[wanted]
    if k ** 3 <= TABLE_CELLS:
        counts = np.bincount(cells, minlength=k ** 3)
        found = np.flatnonzero(counts)
        counts = counts[found]
    else:
        found, counts = np.unique(cells, return_counts=True)
    for cell, n in zip(found.tolist(), counts.tolist()):
        grams[names[cell // (k * k)] + names[cell // k % k] + names[cell % k]] += n


def count_trigrams(docs: DataFrame, text: str = "text") -> DataFrame:
    """(gram, n): character trigrams of the plain words of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: Counter = Counter()
        waiting: list[str] = []

        def empty_out() -> None:
            count_plain("\n".join(waiting), grams)
            waiting.clear()

        def rows() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["gram", "n"])
            grams.clear()
            return batch

        for _, c in rows_of(batches):
            letters = 0
            for raw in c["raw"]:
                for piece in pieces(raw.decode().lower()):
                    if letters + len(piece) > LETTERS_AT_ONCE:
                        empty_out()
                        letters = 0
                    waiting.append(piece)
                    letters += len(piece) + 1
            empty_out()
            if len(grams) > COUNTED:
                yield rows()
        yield rows()

    counted = docs.select(text_bytes(text)).mapInArrow(run, "gram string, n long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


def pieces(text: str) -> Iterator[str]:
    """A text as it is, or, if it is long, its chunks in pieces of ``LETTERS_AT_ONCE`` characters at most; a longer chunk is a piece."""
    if len(text) <= LETTERS_AT_ONCE:
        yield text
        return
    held, letters = [], 0
    for chunk in text.split():
        if held and letters + len(chunk) > LETTERS_AT_ONCE:
            yield " ".join(held)
            held, letters = [], 0
        held.append(chunk)
        letters += len(chunk) + 1
    yield " ".join(held)


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(raw, toxic): about ``limit`` labelled texts that are not held out, copies once.

    The share of ids that is taken follows from their number, so that the sample is bounded at any size.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic"))
    known = known.select(F.col("doc_id").alias("label_id"), "toxic")
    share = min(1.0, limit / max(1, known.count()))
    taken = known.where(F.pmod(F.xxhash64("label_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # About ``limit`` rows of two numbers at any size of the corpus.
    texts = docs.select("doc_id", text_bytes())
    joined = texts.join(F.broadcast(taken), texts["doc_id"] == F.col("label_id")).select("raw", "toxic")
    return joined.groupBy("raw").agg(F.max("toxic").alias("toxic"))


def count_features(sample: DataFrame, counts: tuple[dict, dict, dict], settings: Settings) -> DataFrame:
    """(feature, toxic, clean): documents of either label in which a feature occurs; ``counts`` are those of the character model."""
    letters = sample.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, kept = CharacterModel(*letters.value), {}

        def words_of(chunk: str) -> list[str]:
            found = kept.get(chunk)
            if found is None:
                found = model.words(chunk)
                if len(kept) < KEPT and len(chunk) <= 64:
                    kept[chunk] = found
            return found

        counts = Counter(), Counter()
        for _, c in rows_of(batches):
            for raw, toxic in zip(c["raw"], c["toxic"]):
                words = {w for chunk in set(chunks_of(raw)) for w in words_of(chunk)}
                counts[toxic > 0].update({f for w in words for f in features(w, settings.prefixes)})
            if len(counts[0]) + len(counts[1]) > COUNTED:
                yield from feature_rows(counts)
        yield from feature_rows(counts)

    counted = sample.mapInArrow(run, "feature string, toxic long, clean long")
    return counted.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def feature_rows(counts: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
    for at, found in enumerate(counts):
        n, none = pa.array(list(found.values()), pa.int64()), pa.array([0] * len(found), pa.int64())
        columns = [pa.array(list(found), pa.string()), *((n, none) if at else (none, n))]
        yield pa.RecordBatch.from_arrays(columns, ["feature", "toxic", "clean"])
        found.clear()


def weight(toxic: float, clean: float, prior: float, smoothing: float) -> float:
    """Log-odds that the documents of a feature are toxic, above those of any document."""
    odds = (toxic + smoothing * prior) / (clean + smoothing * (1 - prior))
    return math.log(odds) - math.log(prior / (1 - prior))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> list[float]:
    """Newton steps of a logistic regression with a small ridge."""
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (y - p) - ridge * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return beta.tolist()


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = SETTINGS) -> Model:
    """Character model of all documents, evidence of features, and how evidence becomes a probability.

    The last step sees every sample text as one that did not count towards its own evidence.  Without
    toxic or without clean labels, every score is the share of toxic ones (0 if there are no labels).
    """
    spark = docs.sparkSession
    counts = character_counts(docs, settings)
    sample = cut_lineage(labelled_sample(docs, labels, settings.labelled))
    size = sample.agg(F.sum((F.col("toxic") > 0).cast("long")).alias("toxic"), F.count("*").alias("n")).first()
    toxic, n = size.toxic or 0, size.n
    if not 0 < toxic < n:
        odds = 30.0 if toxic else -30.0
        release(sample)
        return Model(counts[0], {}, [odds, *[0.0] * (settings.top + 1)], settings, "", *counts[1:])
    prior = toxic / n
    # Bounded by the sample: a text adds to few features, and each needs its share of the toxic texts.
    known = count_features(sample, counts, settings).where(F.col("toxic") >= max(2, toxic // settings.support)).where(
        F.col("toxic") * (1 - prior) > settings.lift * F.col("clean") * prior).toPandas()
    pairs = dict(zip(known.feature, zip(known.toxic.tolist(), known.clean.tolist())))
    shared = spark.sparkContext.broadcast((counts, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value[1]
        reader = Reader(CharacterModel(*shared.value[0]), known, settings)
        for _, c in rows_of(batches):
            xs = []
            for raw, label in zip(c["raw"], c["toxic"]):
                n_chunks, words, more = reader.read(raw)
                best = []
                own = {f for w in words for f in features(w, settings.prefixes)}
                for w in words | more:
                    found = [weight(known[f][0] - (f in own and label > 0), known[f][1] - (f in own and label <= 0), prior, settings.smoothing)
                             for f in features(w, settings.prefixes) if f in known]
                    if found and max(found) > 0:
                        best.append(max(found))
                xs.append(inputs(best, n_chunks, settings.top))
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.float64())), pa.array([int(t > 0) for t in c["toxic"]])], ["x", "y"])

    seen = sample.mapInArrow(run, "x array<double>, y long").toPandas()
    coefficients = fit_logistic(np.array(seen.x.tolist()), seen.y.to_numpy(float))
    weights = {f: w for f, (t, c) in pairs.items() if (w := weight(t, c, prior, settings.smoothing)) > 0}
    release(sample)
    return Model(counts[0], weights, coefficients, settings, "", *counts[1:])


def character_counts(docs: DataFrame, settings: Settings) -> tuple[dict[str, int], dict[str, int], dict[str, int]]:
    """(trigrams, bigrams, letters) of all documents.

    Bigrams and letters are added up from all trigrams.  Trigrams and bigrams rarer than one in ``settings.letters``
    letters count as unseen: that share bounds what is collected, whatever the scripts, and spares none
    that a corpus of fewer letters holds.
    """
    grams = cut_lineage(count_trigrams(docs))
    total = grams.agg(F.sum("n")).first()[0] or 0
    least, n = total / settings.letters, F.sum("n").alias("n")
    two = grams.groupBy(F.substring("gram", 1, 2).alias("gram")).agg(n).where(F.col("n") >= least)
    one = grams.groupBy(F.substring("gram", 3, 1).alias("gram")).agg(n)
    found = []
    for counted in (grams.where(F.col("n") >= least), two, one):
        rows = counted.toPandas()
        found.append(dict(zip(rows.gram, rows.n.tolist())))
    release(grams)
    return found[0], found[1], found[2]


#: One scorer per worker process and model, so that tasks share what it has kept.
SCORERS: dict[int, Scorer] = {}


def scorer(model: Model):
    """A column function from whole texts (bytes) to scores between 0 and 1."""
    shared = SparkSession.active().sparkContext.broadcast(model)
    key = shared._jbroadcast.id()

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in SCORERS:
            SCORERS.clear()
            SCORERS[key] = Scorer(shared.value)
        for raws in batches:
            yield pd.Series([SCORERS[key].score(raw) for raw in raws], dtype="float64")

    return run


def scores(docs: DataFrame, labels: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row: score is the probability of label 1.

    Null texts count as empty; empty texts get what a text without evidence gets.  Repeated rows come
    back as often as they occur.  Labels for unknown documents, null labels and null ids are ignored;
    of several labels of a document the highest counts.
    """
    score = scorer(fit(docs, labels, settings))
    scored = docs.select("doc_id", held_out().alias("held_out"), score(text_bytes()).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def kept(docs: DataFrame, labels: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """The rows of ``docs``, unchanged, whose score is below one half."""
    score = scorer(fit(docs, labels, settings))
    name = unused(docs, "toxicity_score")
    return docs.withColumn(name, score(text_bytes())).where(F.col(name) < 0.5).drop(name)


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

A template of m shingles (five words each, fewer where it is shorter) is looked for in windows of 2m'
shingles, one every m', where m' is the power of two from m on.  Some window then holds the whole of a match, and shares
at least a fifth of all shingles with the template.  With ``BANDS`` bands of one MinHash each, such a window
misses its template with probability (1 - 0.2)^BANDS at most, below 1e-6.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import rows_of, table, text_bytes
from tidemark.llm.registry import query

SHINGLE, CONTAINMENT, BANDS = 5, 0.8, 64
WORDS = re.compile(r"\w+")

# Notices that are looked for.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                         "compliance with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
           "the following conditions are met:",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                  "General Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                 "associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

FACTORS = np.random.default_rng(3).integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MULTIPLY, ADD = np.random.default_rng(5).integers(1, 1 << 63, (2, BANDS), dtype=np.uint64)


def word_hashes(text: str) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w.lower()) for w in WORDS.findall(text)], np.uint64)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = sum((words[k:k + n] * FACTORS[k] for k in range(size)), np.zeros(n, np.uint64))
    return (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Templates:
    """Shingles of the templates, and their MinHash in each band, by shingle size and window step."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.groups: dict[tuple[int, int], dict[str, np.ndarray]] = defaultdict(dict)
        for name, text in sorted(texts.items()):
            words = word_hashes(text)
            if len(words):
                shingles = np.unique(shingle_hashes(words, size := min(SHINGLE, len(words))))
                length = len(words) - size + 1
                self.groups[size, 1 << (length - 1).bit_length()][name] = shingles
        self.length = {name: len(WORDS.findall(text)) for name, text in texts.items()}
        self.bands = {key: (list(group), np.stack([mix(s).min(axis=1) for s in group.values()])) for key, group in self.groups.items()}

    def find(self, text: str) -> list[tuple[str, int, int, float]]:
        """(template, first word, word after the last, containment) of the matches, by place."""
        words, found = word_hashes(text), []
        for (size, step), group in self.groups.items():
            shingles = shingle_hashes(words, size)
            if not len(shingles):
                continue
            names, mins = self.bands[size, step]
            # Windows that hold no shingle of any template cannot verify; the others get their MinHash.
            starts = np.arange(0, max(1, len(shingles) - step), step)
            ends = np.minimum(starts + 2 * step, len(shingles))
            hit = np.concatenate([[0], np.cumsum(np.isin(shingles, np.concatenate(list(group.values()))))])
            for lo, hi in zip(starts[hit[ends] > hit[starts]], ends[hit[ends] > hit[starts]]):
                window = shingles[lo:hi]
                for t in np.flatnonzero((mix(window).min(axis=1)[None, :] == mins).any(axis=1)):
                    found += self.verified(names[t], group[names[t]], window, int(lo), size)
        best: dict[tuple[str, int, int], float] = {}
        for name, lo, hi, share in found:
            best[name, lo, hi] = max(share, best.get((name, lo, hi), 0.0))
        return sorted(outermost(best), key=lambda m: (m[1], m[0], m[2]))

    def verified(self, name: str, shingles: np.ndarray, window: np.ndarray, lo: int, size: int):
        """Stretches of the window in which enough of the template's shingles stand."""
        at = np.flatnonzero(np.isin(window, shingles))
        length = self.length[name] + SHINGLE
        for part in np.split(at, np.flatnonzero(np.diff(at) > length) + 1) if len(at) else []:
            share = len(np.unique(window[part])) / len(shingles)
            if share >= CONTAINMENT:
                yield name, lo + int(part[0]), lo + int(part[-1]) + size, share


def mix(shingles: np.ndarray) -> np.ndarray:
    return (shingles[None, :] * (MULTIPLY[:, None] | np.uint64(1)) + ADD[:, None]) ^ (shingles[None, :] >> np.uint64(31))


def outermost(found: dict[tuple[str, int, int], float]) -> list[tuple[str, int, int, float]]:
    """Matches of one template that overlap, as one stretch with the highest share."""
    out: list[tuple[str, int, int, float]] = []
    for (name, lo, hi), share in sorted(found.items()):
        if out and out[-1][0] == name and lo < out[-1][2]:
            out[-1] = (name, out[-1][1], max(hi, out[-1][2]), max(share, out[-1][3]))
        else:
            out.append((name, lo, hi, share))
    return out


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, start, end, containment): a row per notice found in a whole text, places in code points.

    Case and punctuation do not matter.  Null and empty texts, and texts without a match, have no rows;
    repeated rows have theirs each.
    """
    texts = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(texts)
        for batch, c in rows_of(batches):
            rows, index = [], []
            for i, raw in enumerate(c["raw"]):
                whole = raw.decode()
                found = known.find(whole)
                if found:
                    places = [m.span() for m in WORDS.finditer(whole)]
                    rows += [(name, places[lo][0], places[hi - 1][1], share) for name, lo, hi, share in found]
                    index += [i] * len(found)
            if rows:
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64()]
                columns = [pa.array(x, k) for x, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index)), *columns], ["doc_id", "license", "start", "end", "containment"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), text_bytes(text)).mapInArrow(
        run, f"doc_id {kind}, license string, start int, end int, containment double")


@query("op3_licenses")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))

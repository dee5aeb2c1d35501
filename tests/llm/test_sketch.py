"""SimHash in the near-dedup stage: its fingerprints and the pairs that it proposes, against brute force."""

import numpy as np
import xxhash

from tidemark.llm import similar
from tidemark.llm.common import prepare


def test_simhash_proposes_pairs_at_four_bits(spark):
    prepare(spark)
    base = [f"w{k}" for k in range(300)]
    texts = [" ".join(base[:i % 7] + [f"x{i}"] + base[i % 7:]) for i in range(8)] + [" ".join(f"y{i}x{k}" for k in range(60)) for i in range(4)]
    prints = {}
    for i, text in enumerate(texts):
        words = text.split()
        hashes = {xxhash.xxh64_intdigest(" ".join(words[k:k + 5]).encode(), 42) for k in range(len(words) - 4)}
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert similar.sketch(similar.shingles(text.encode())) % (1 << 64) == prints[i]
    assert similar.sketch(np.zeros(0, np.int64)) == 0
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in prints.items()]
    label = {i: i for i in prints}

    def join(pairs):
        found = {i: {i} for i in prints}
        for a, b in pairs:
            both = found[a] | found[b]
            for i in both:
                found[i] = both
        return sorted({tuple(sorted(v)) for v in found.values()})

    want = join([(a, b) for a in label for b in label if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    assert 1 < len(want) < len(prints)
    got = similar.by_bits(spark.createDataFrame(rows, "fp long, print long")).collect()
    assert all(r.a < r.b for r in got) and join([(r.a, r.b) for r in got]) == want

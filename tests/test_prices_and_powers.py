"""The fit takes one power per row and exponent in blocks of rows; an allocation is computed once and then read."""

import tracemalloc

import numpy as np
import pytest

from tidemark.operators import allocate as A
from tidemark.operators import response as P


def plain(s, r):
    """The fixed grid as written down: one power per row and candidate."""
    best = None
    for k in P.COARSE_K:
        for n in P.COARSE_N:
            h = 1 / (1 + (s / (k * s.max())) ** -n)
            v = np.clip((r @ h) / (h @ h), P.V_BOUNDS[0] * r.max(), P.V_BOUNDS[1] * r.max())
            sse = ((r - v * h) ** 2).sum()
            if best is None or sse < best[3] * (1 - 1e-12):
                best = k, n, v, sse
    return best


@pytest.mark.parametrize("n_rows", [9, P.FIT_BLOCK, 3 * P.FIT_BLOCK + 1])
def test_separate_powers_find_the_same_candidate(n_rows):
    rng = np.random.default_rng(n_rows)
    s = rng.uniform(1, 900, n_rows)
    r = 800 / (1 + (s / 120) ** -1.3) * rng.uniform(0.7, 1.3, n_rows)
    found, wanted = P._grid_search(0)(s, r), plain(s, r)
    assert found[:2] == wanted[:2] and found[2:] == pytest.approx(wanted[2:], rel=1e-9)


def test_a_long_history_meets_the_grid_in_blocks():
    s = np.random.default_rng(1).uniform(1, 900, 100_000)
    search = P._grid_search(0)
    tracemalloc.start()
    try:
        search(s, 5 * s)
        assert tracemalloc.get_traced_memory()[1] < 20e6  # 96 MB for one table of all rows and candidates
    finally:
        tracemalloc.stop()


def test_allocation_is_stored_once(spark):
    rows = spark.createDataFrame([(c, 1000.0 + c, 50.0, 0.8, 30.0, 70.0) for c in range(700)],
                                 "campaign_id bigint, v_max double, k double, n double, low double, high double")
    filled, _, _ = A._search(rows, 35_000.0)
    assert filled.stored_at and filled.agg({"optimal_spend": "sum"}).first()[0] == pytest.approx(35_000.0)


def test_totals_over_blocks_of_campaigns(spark):
    rng = np.random.default_rng(3)
    n = 2 * A.PRICED_ROWS + 7
    c = [rng.uniform(*b, n) for b in ((1e3, 1e5), (1, 900), (0.4, 4), (0, 40), (40, 90))]
    rows = spark.createDataFrame([tuple(map(float, x)) for x in zip(*c)], "v_max double, k double, n double, low double, high double")
    prices = [0.5, 3.0, 40.0]
    direct = A._chooser()(*[x[:, None] for x in c], np.array(prices)[None, :]).sum(axis=0)
    assert [A._totals(rows, prices)[p] for p in prices] == pytest.approx(direct.tolist(), rel=1e-12)

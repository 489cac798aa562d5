"""All pairs by blocks: what moves, and how they are multiplied."""

import numpy as np
import pytest

from simjoin.functions.metric import L2
from simjoin.operators import profile, sparse
from simjoin.operators.naive import BLOCK, blocks_and_ways
from simjoin.operators.topk import QUERIES
from tests.test_joins import frame


def test_rows_that_move_grow_with_the_tables():
    moved = lambda n_q, n_db: n_q * (b := blocks_and_ways(n_q, n_db, 200))[0] + n_db * b[1]
    for share in (1, 10):  # once there is work for all tasks
        assert moved(600_000 // share, 600_000) <= 10 * moved(100_000 // share, 100_000)
    assert moved(100_000, 100_000) <= 3_100_000  # 10,500,000 by a block for each 1,000 objects
    for n_q, n_db, tasks in ((0, 0, 5), (1, 0, 5), (0, 7, 5), (3, 500, 8), (50_000, 10, 8), (10**6, 10**7, 200)):
        blocks, ways = blocks_and_ways(n_q, n_db, tasks)
        assert blocks >= max(1, n_db / BLOCK) and ways >= max(1, n_q / QUERIES)


@pytest.mark.parametrize("filled", [0.02, 0.2, 1.0])
def test_products_as_matrices_and_by_lists(monkeypatch, filled):
    rng = np.random.default_rng(3)

    def block(n):
        there = rng.random((n, 40)) < filled
        return sparse.Block(np.zeros(n, np.float32), np.concatenate([[0], np.cumsum(there.sum(1))]), np.nonzero(there)[1], rng.standard_normal(int(there.sum())).astype(np.float32)), there

    (q, in_q), (s, in_s) = block(70), block(90)
    dense = [np.zeros(there.shape) for there in (in_q, in_s)]
    for d, there, b in zip(dense, (in_q, in_s), (q, s)):
        d[there] = b.values
    monkeypatch.setattr(sparse, "BINS", 7)
    seen, kept = [], sparse._dense
    monkeypatch.setattr(sparse, "_dense", lambda *a: seen.append(1) or kept(*a))
    assert np.allclose(sparse.products(q, s), dense[0] @ dense[1].T) and bool(seen) == (filled > 0.1)


def test_histogram_by_products(spark):
    """Equal to exact distances in every step, over copies, rows almost alike and distances on the edges of steps; few distances are computed by the definition."""
    rng = np.random.default_rng(4)
    s = np.concatenate([rng.integers(0, 9, (150, 2)), rng.integers(0, 9, (100, 2)) + 1e-4 * rng.random((100, 2)), np.repeat(rng.random((3, 2)), 20, 0)]).astype(np.float32)
    d = L2().all_pairs(s, s)[np.tril_indices(len(s), -1)].astype(np.float64)
    for bins in (5, 200):
        low, width = d.min(), (d.max() - d.min()) / bins
        want = np.bincount(np.minimum(bins - 1, np.floor((d - low) / width + 0.5).astype(int)), minlength=bins)
        got = profile.distance_histogram(frame(spark, s), 1.0, bins).collect()
        assert [r["count"] for r in got] == want[want > 0].tolist()
    x, y = rng.standard_normal((2, 300, 64)).astype(np.float32)
    pairs = profile._Pairs(L2(), x, y, None, None)
    assert np.abs(pairs.rough - L2().all_pairs(x, y).ravel()).max() <= pairs.off < 1e-5

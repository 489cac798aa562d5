"""How much of the exact result the registered approximate queries find, on the test tables."""

import os
from pathlib import Path

import pytest

from simjoin.operators.naive import knn_naive
from simjoin.queries import QUERIES, K, asked_items, item_join, items

DATA = os.environ.get("SIMJOIN_RECALL_DATA", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")
APPROXIMATE = ("knn_pivot_approx", "knn_query_rep", "knn_eps_guaranteed", "knn_eps_approx", "knn_curve_window", "knn_curve_z_only", "knn_curve_buckets", "knn_curve_sketched", "knn_curve_hilbert", "knn_lsh", "knn_lsh_fitted", "knn_lsh_selected")


@pytest.fixture(scope="module")
def exact(spark):
    return {(r.query_id, r.db_id): r["rank"] for r in QUERIES["knn_naive"](spark, DATA).collect()}


@pytest.mark.parametrize("name", APPROXIMATE)
def test_recall(spark, exact, name):
    found = {(r.query_id, r.db_id) for r in QUERIES[name](spark, DATA).collect()}
    k = 5 if name == "knn_lsh" else K
    want = {x for x, rank in exact.items() if rank <= k}
    recall = len(want & found) / len(want)
    print(f"{name} {recall:.3f}")
    assert recall >= 0.9


@pytest.mark.parametrize("options", [{}, dict(method="APPROX", max_rec_depth=8, filter_ratio=0.06), dict(method="QUERY_REP", max_rec_depth=8, filter_ratio=0.06), dict(method="EPSILON_GUARANTEED", epsilon=1.2), dict(method="EPSILON_APPROX", epsilon=1.2, max_rec_depth=8)])
def test_pruning_on_vectors_with_structure(spark, exact_items, options):
    """Nine tenths of the neighbours, from a fifth of the pairs at most."""
    plan, s = item_join(spark, DATA, **options), items(spark, DATA)
    found = {(r.query_key, r.db_key) for r in plan.result().collect()}
    recall, share = len(exact_items & found) / len(exact_items), plan.observed["distance_computations"].get["n"] / (s.count() * asked_items(s).count())
    print(f"{options.get('method', 'EXACT')} recall {recall:.3f} share {share:.3f}")
    assert recall >= (0.9 if options else 1) and share <= 0.2


@pytest.fixture(scope="module")
def exact_items(spark):
    s = items(spark, DATA)
    return {(r.query_key, r.db_key) for r in knn_naive(asked_items(s), s, K).collect()}


def test_sweep_grid(spark):
    """The exact rows are right, no approximation is nearer, and one that visits more is no farther."""
    rows = QUERIES["sweep_grid"](spark, DATA).collect()
    kth = [r.distance for r in QUERIES["knn_naive"](spark, DATA).where("rank = 5").collect()]
    exact = {"AVG": sum(kth) / len(kth), "MAX": max(kth)}
    assert len(rows) == 3 * 2 * 2 * 2
    found = {(r.stat, r.method, r.max_rec_depth, r.filter_ratio): r.value for r in rows}
    for (stat, method, depth, ratio), value in found.items():
        assert value == pytest.approx(exact[stat], abs=1e-4) if method == "EXACT" else value >= exact[stat] - 1e-4
        assert found[stat, method, depth, 0.5] <= found[stat, method, depth, 0.2] + 1e-6
    assert any(value > exact[stat] + 1e-3 for (stat, method, *_), value in found.items() if method != "EXACT")

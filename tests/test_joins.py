import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from simjoin.functions import hashing, hilbert, metric, quantiles, zorder
from simjoin.functions.metric import L2, L2Quantized, block_topk, l2_sparse
from simjoin.operators import bounds, curve, evaluate, kmeans, lsh, pivot_index, pivot_join, pivots, profile, sparse, topk
from simjoin.operators.pivot_index import PivotIndex
from simjoin.operators.pivot_join import PivotJoin
from simjoin.plans import sweep as sweep_module
from simjoin.plans.config import CurveConfig, LshConfig, PivotConfig
from simjoin.plans.knn import knn_join
from simjoin.plans.metrics import measured
from simjoin.plans.sweep import SweepConfig, append_csv, sweep
from simjoin.sources import features

TYPE = "key long, classification int, vector array<float>"


def frame(spark, vectors, start=0):
    return spark.createDataFrame([(start + i, i % 3, [float(x) for x in v]) for i, v in enumerate(vectors)], TYPE)


def brute(q, s, k, q0=0, s0=0):
    d = L2().all_pairs(np.asarray(q, np.float32), np.asarray(s, np.float32))
    return {q0 + i: sorted((float(d[i, j]), s0 + j) for j in range(len(s)))[:k] for i in range(len(q))}


def lists(found):
    out = {}
    for r in found.orderBy("query_key", "rank").collect():
        out.setdefault(r.query_key, []).append((r.distance, r.db_key))
    return out


def data(seed, n, dim=3, tied=False):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 4, (n, dim)).astype(np.float32) if tied else rng.standard_normal((n, dim)).astype(np.float32)


def test_sparse_metric(spark):
    t = "struct<other:float,bin_keys:array<int>,bin_values:array<float>>"

    def d(x, y):
        df = spark.createDataFrame([(x, y)], f"x {t}, y {t}")
        return df.select(l2_sparse(F.col("x"), F.col("y")).alias("d")).first().d

    assert d((0.0, [0, 1, 9], [0.2, 0.8, 0.0]), (0.1, [0, 9], [0.2, 0.1])) == pytest.approx(0.7549834, abs=1e-6)
    assert d((0.0, [0], [3.0]), (0.0, [1], [4.0])) == 5.0
    with pytest.raises(Exception, match="dimension"):
        d((1.0, [1], [1.0]), (0.0, [2], [0.0]))


RECORDS = "key long, classification int, other float, bin_keys array<int>, bin_values array<float>"


def records(rng, n, dim, defaults, start=0):
    """Records that name some bins and always the last one."""
    out = []
    for i in range(n):
        bins = sorted({*rng.choice(dim, rng.integers(0, dim), replace=False).tolist(), dim - 1})
        out.append((start + i, i % 3, float(rng.choice(defaults)), bins, [float(x) for x in rng.integers(0, 4, len(bins))]))
    return out


@pytest.mark.parametrize("defaults", [[0.0], [0.0, 0.5, 2.0]])
def test_sparse_join(spark, defaults, monkeypatch):
    """Against the dense join of the same records, in small batches, with ties, records without other bins and a huge dimension."""
    rng = np.random.default_rng(len(defaults))
    q, s = (spark.createDataFrame(records(rng, n, 23, defaults), RECORDS) for n in (40, 300))
    monkeypatch.setattr(sparse, "PAIRS", 900)
    dense_lists = lists(knn_join(features.dense(q, 23), features.dense(s, 23), 6, "naive"))
    assert lists(knn_join(q, s, 6, "sparse")) == dense_lists
    both = q.alias("q").where("key < 5").join(s.alias("s")).select(F.col("q.key").alias("a"), F.col("s.key").alias("b"), l2_sparse(F.struct("q.other", "q.bin_keys", "q.bin_values"), F.struct("s.other", "s.bin_keys", "s.bin_values")).alias("d"))
    d = {(r.a, r.b): r.d for r in both.collect()}
    assert all(d[a, key] == pytest.approx(x, abs=1e-6) for a in range(5) for x, key in dense_lists[a])
    far = [(1, 0, 0.0, [5, 2_000_000_000], [3.0, 4.0]), (2, 0, 0.0, [], []), (3, 0, 0.0, [5], [3.0])]
    wide = spark.createDataFrame(far, RECORDS)
    assert lists(knn_join(wide, wide, 3, "sparse"))[2] == [(0.0, 2), (3.0, 3), (5.0, 1)]


def test_sparse_join_says_what_does_not_fit(spark):
    ok = spark.createDataFrame([(1, 0, 1.0, [3], [1.0])], RECORDS)
    for other, text in (((2, 0, 0.0, [4], [1.0]), "dimension"), ((2, 0, 1.0, [3, 1], [1.0, 1.0]), "ascending"), ((2, 0, 1.0, [3], [1.0, 2.0]), "one value")):
        with pytest.raises(Exception, match=text):
            knn_join(ok, spark.createDataFrame([other], RECORDS), 1, "sparse").collect()


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 10**6))
def test_metric_axioms_and_block_search(seed):
    x = data(seed, 40, 5, tied=bool(seed % 2))
    d = L2().all_pairs(x, x).astype(np.float64)
    assert (d == d.T).all() and (np.diag(d) == 0).all()
    assert (d[:, None, :] <= d[:, :, None] + d[None, :, :].transpose(0, 2, 1).transpose(0, 2, 1) + 1e-5).all()
    qi, si, di = block_topk(L2(), x[:7], x, 6)
    want = brute(x[:7], x, 6)
    assert [(float(a), int(b)) for a, b in zip(di, si)] == [p for i in range(7) for p in want[i]]


def test_column_and_kernel_agree(spark):
    x, y = data(1, 50, 16), data(2, 50, 16)
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "x array<float>, y array<float>")
    got = [r.d for r in df.select(L2().column(F.col("x"), F.col("y")).alias("d")).collect()]
    assert np.allclose(got, L2().rows(x, y), rtol=0, atol=0)


@pytest.mark.parametrize("tied", [False, True])
def test_exact_joins_match_brute_force(spark, tied):
    q, s = data(3, 25, tied=tied), data(4, 120, tied=tied)
    want = brute(q, s, 5)
    fq, fs = frame(spark, q), frame(spark, s)
    assert lists(knn_join(fq, fs, 5)) == want
    assert lists(knn_join(fq, fs, 5, "naive", block=17)) == want
    config = dict(pivot_count=12, static_count=3, groups=4)
    assert lists(knn_join(fq, fs, 5, "pivot", PivotConfig(**config))) == want
    assert lists(knn_join(fq, fs, 5, "pivot", PivotConfig(**config | dict(static_count=0, groups=1)))) == want
    full = config | dict(max_rec_depth=12, filter_ratio=1.0)
    assert lists(knn_join(fq, fs, 5, "pivot", PivotConfig(**full, method="approx"))) == want
    assert lists(knn_join(fq, fs, 5, "pivot", PivotConfig(**full, method="query_rep"))) == want


def test_replication_bound_keeps_a_needed_object(spark):
    s, q = [[-5.9], [0], [5.01], [10]], [[0.1]]
    found = lists(knn_join(frame(spark, q), frame(spark, s), 2, "pivot", PivotConfig(pivot_count=2, static_count=0, groups=2), pivots=np.array([[0.0], [10.0]])))
    assert [k for _, k in found[0]] == [1, 2]


@pytest.mark.parametrize("seed", range(4))
def test_exact_pivot_join_on_a_line(spark, seed):
    s, q = data(seed, 14, 1) * 5, data(seed + 50, 6, 1) * 5
    assert lists(knn_join(frame(spark, q), frame(spark, s), 3, "pivot", PivotConfig(pivot_count=4, static_count=2, groups=3))) == brute(q, s, 3)


def test_epsilon_guarantee_and_approximations(spark):
    q, s = data(5, 30, 6), data(6, 300, 6)
    want, fq, fs = brute(q, s, 5), frame(spark, q), frame(spark, s)
    for method, epsilon in (("EPSILON_GUARANTEED", 1.3), ("APPROX", 1.0), ("EPSILON_APPROX", 1.2), ("QUERY_REP", 1.0)):
        config = PivotConfig(pivot_count=20, static_count=4, groups=5, method=method, epsilon=epsilon, max_rec_depth=4, filter_ratio=0.2)
        got = lists(knn_join(fq, fs, 5, "pivot", config))
        for i, found in got.items():
            assert found == sorted(found) and len({k for _, k in found}) == len(found)
            assert all(d >= e - 1e-6 for (d, _), (e, _) in zip(found, want[i]))
            if method == "EPSILON_GUARANTEED":
                assert len(found) == 5 and found[-1][0] <= epsilon * want[i][-1][0] + 1e-5


@pytest.mark.parametrize("seed", range(3))
def test_epsilon_guarantee_at_every_rank(spark, seed):
    q, s = data(60 + seed, 40, 16), data(70 + seed, 200, 16)
    want, epsilon = brute(q, s, 10), 2.0
    config = PivotConfig(pivot_count=25, static_count=4, groups=6, method="EPSILON_GUARANTEED", epsilon=epsilon)
    got = lists(knn_join(frame(spark, q), frame(spark, s), 10, "pivot", config))
    fine = lambda got: all(len(got[i]) == 10 and all(d <= epsilon * e + 1e-5 for (d, _), (e, _) in zip(got[i], want[i])) for i in want)
    assert fine(got)
    # every object a pivot: bounds are tight
    want = brute(q, s[:30], 10)
    config = PivotConfig(pivot_count=30, static_count=2, groups=1, method="EPSILON_GUARANTEED", epsilon=epsilon)
    assert fine(lists(knn_join(frame(spark, q), frame(spark, s[:30]), 10, "pivot", config, pivots=s[:30])))


def test_bounds_hold(spark):
    q, s = data(7, 20, 4), data(8, 200, 4)
    want = brute(q, s, 5)
    for method in ("EXACT_BOUNDS", "APPROX_BOUNDS"):
        config = PivotConfig(pivot_count=15, static_count=3, groups=4, method=method, max_rec_depth=3, filter_ratio=0.3)
        for r in knn_join(frame(spark, q), frame(spark, s), 5, "pivot", config).collect():
            assert r.upper_bound >= want[r.query_key][-1][0] - 1e-6
    assert bounds.kth(np.array([3.0, 1.0]), 3) == np.inf


class L1:
    """Another metric for the joins that take any."""

    def all_pairs(self, x, y):
        return np.abs(x[:, None].astype(np.float64) - y[None].astype(np.float64)).sum(-1).astype(np.float32)

    def rows(self, x, y):
        return np.abs(x.astype(np.float64) - y.astype(np.float64)).sum(-1).astype(np.float32)


def test_joins_take_a_metric(spark):
    q, s = data(20, 25, 4), data(21, 150, 4)
    d = L1().all_pairs(q, s)
    want = {i: sorted((float(x), j) for j, x in enumerate(row))[:5] for i, row in enumerate(d)}
    fq, fs = frame(spark, q), frame(spark, s)
    assert lists(knn_join(fq, fs, 5, "naive", metric=L1())) == want
    assert lists(knn_join(fq, fs, 5, "pivot", PivotConfig(pivot_count=12, static_count=3, groups=4), metric=L1())) == want
    assert lists(knn_join(fq, fs, 5, "lsh", LshConfig(tables=1, functions=1, w=1e6, multiplier=1), metric=L1())) == want


def test_blocks_of_queries_and_objects(spark, monkeypatch):
    q, s = data(22, 90, 3, tied=True), data(23, 300, 3)
    want, fq, fs = brute(q, s, 6), frame(spark, q), frame(spark, s)
    plan = PivotJoin(fq, fs, 6, PivotConfig(pivot_count=9, static_count=2, groups=1), s[:9])
    known = pivot_join.Known(plan.voronoi, plan.groups, 1.0, True, True, None, {})
    one = {"cell": F.get("nearest_pivots", F.lit(0)), "dist": F.get("nearest_dists", F.lit(0)), "g": F.lit("0")}
    q_rows, s_rows = (df.withColumns(one).orderBy("cell", "dist", "key").toArrow() for df in (plan.queries, plan.database))
    for blocks in ((256, 4_096, 1_000), (7, 5, 64), (1, 1, 9)):
        monkeypatch.setattr(pivot_join, "QUERY_BLOCK", blocks[0])
        monkeypatch.setattr(pivot_join, "OBJECT_BLOCK", blocks[1])
        scan = pivot_join.pruned_search(known)(q_rows)
        for batch in s_rows.to_batches(blocks[2]):
            scan.see(batch)
        got = {i: [] for i in range(90)}
        for row in pa.Table.from_batches(scan.nearest.lists(q_rows, scan.cost)).to_pylist():
            got[row["query_key"]].append((row["distance"], row["db_key"]))
        assert {i: sorted(x) for i, x in got.items()} == want and 0 < scan.cost <= 90 * 309
    assert lists(knn_join(fq, fs, 6, "pivot", PivotConfig(pivot_count=30, groups=2, group_objects=20))) == want
    assert len(set(PivotJoin(fq, fs, 6, PivotConfig(pivot_count=30, groups=2, group_objects=20)).groups)) == 15


def test_nearest_holds_the_least_keys_of_ties():
    """Batches in any order, many ties, keys of several parts; what is forgotten is not needed."""
    rng = np.random.default_rng(4)
    d, keys = rng.integers(0, 3, (12, 5000)).astype(np.float32), [{"a": int(x), "b": int(y)} for x, y in zip(rng.permutation(5000) // 7, rng.permutation(5000))]
    batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.struct([("a", pa.int32()), ("b", pa.int32())])), pa.array([0] * 5000, pa.int32())], names=["key", "classification"])
    held = topk.Nearest(12, 4)
    for at in range(0, 5000, 300):
        part = batch.slice(at, 300)
        i, j = (x.ravel() for x in np.indices((12, len(part))))
        held.add(i, d[:, at : at + 300].ravel(), j, part)
    assert held.size < 12 * 4 * 5 + 10_000 + 300 * 12
    held._forget()
    q = pa.table({"key": list(range(12)), "classification": [0] * 12})
    got = {}
    for r in pa.Table.from_batches(held.lists(q, 7)).to_pylist():
        got.setdefault(r["query_key"], []).append((r["distance"], r["db_key"]["a"], r["db_key"]["b"]))
    assert got == {i: sorted((float(x), k["a"], k["b"]) for x, k in zip(d[i], keys))[:4] for i in range(12)}


def test_no_group_is_held_whole(spark, monkeypatch):
    """Arrow batches of a few rows, and both sides of every group dealt to several tasks."""
    q, s = data(31, 120, 4), data(32, 700, 4)
    fq, fs, want = frame(spark, q), frame(spark, s), brute(q, s, 5)
    monkeypatch.setattr(topk, "QUERIES", 30)
    monkeypatch.setattr(topk, "OBJECTS", 100)
    config = dict(pivot_count=20, static_count=3, groups=3)
    plan = PivotJoin(fq, fs, 5, PivotConfig(**config))
    groups = plan.groups
    _, _, most = plan._copied(groups)
    assert all(r.ways >= 1 and r.parts > 1 for r in plan._shares(None, None, groups, most).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        for more in (dict(), dict(method="APPROX", max_rec_depth=20, filter_ratio=1.0), dict(method="QUERY_REP", max_rec_depth=20, filter_ratio=1.0)):
            assert lists(knn_join(fq, fs, 5, "pivot", PivotConfig(**config, **more))) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("seed", range(4))
def test_copies_by_cut_regions(spark, seed):
    """Never more copies than the lower bound alone gives, and never one too few."""
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-20, 20, (12, 3))
    points = lambda n: (centres[rng.integers(0, 12, n)] + rng.standard_normal((n, 3))).astype(np.float32)
    q, s = points(60), points(500)
    fq, fs = frame(spark, q), frame(spark, s)
    copies = {}
    for cut in (True, False):
        plan = PivotJoin(fq, fs, 4, PivotConfig(pivot_count=24, static_count=5, groups=6, cut_copies=cut))
        assert lists(plan.result()) == brute(q, s, 4)
        copies[cut] = plan.observed["db_replications"].get["n"]
    assert copies[True] < copies[False]


def test_planes_exclude_more_than_differences(spark):
    rng = np.random.default_rng(2)
    for _ in range(200):
        p1, p2, x = rng.standard_normal((3, 3))
        o = rng.standard_normal((400, 3))
        o = o[np.linalg.norm(o - p2, axis=1) <= np.linalg.norm(o - p1, axis=1)]
        d, home, between = np.linalg.norm(x - p2), np.linalg.norm(x - p1), np.linalg.norm(p1 - p2)
        plane = float(bounds.beyond_plane(L2(), d, home, between))
        assert plane >= (d - home) / 2 - 1e-9 or d < home
        assert plane <= np.linalg.norm(o - x, axis=1).min(initial=np.inf) + 1e-9
        assert bounds.beyond_plane(L1(), d, home, between) == (d - home) / 2
    assert bounds.beyond_plane(L2(), np.array([1.0]), np.array([1.0]), np.array([0.0]))[0] == 0

    class Plain(L2):
        four_point = False

    q, s = data(41, 80, 2), data(42, 900, 2)
    cost, lists_ = {}, {}
    for metric in (L2(), Plain()):
        plan = PivotJoin(frame(spark, q), frame(spark, s), 3, PivotConfig(pivot_count=40, static_count=0, groups=2), s[:40], metric)
        lists_[metric.four_point] = lists(plan.result())
        cost[metric.four_point] = plan.observed["distance_computations"].get["n"]
        told = plan.exclusions().agg(F.sum("by_difference"), F.sum("by_plane"), F.max("cells")).first()
        assert told[2] == 40 and (told[1] > told[0]) == metric.four_point
    assert lists_[True] == lists_[False] == brute(q, s, 3) and cost[True] < cost[False]


def test_index_that_grows(spark, tmp_path):
    """After appends a join finds what a rebuilt one finds, statistics are those of a rebuild, and old versions stay as they were."""
    q, s = data(51, 30, 3), data(52, 400, 3)
    fq, path = frame(spark, q), str(tmp_path / "index")
    index = PivotIndex.create(frame(spark, s[:250]), path, 6, static_count=3, depth=12, pivots=s[:12])
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "index").rglob("*.parquet")}
    assert [index.append(frame(spark, part, at)) for at, part in ((250, s[250:390]), (390, s[390:]))] == [1, 2]
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    again = PivotIndex.open(spark, path)
    assert again.versions == [0, 1, 2] and again.depth == 12 and again.static.tolist() == index.static.tolist()
    for more in (dict(), dict(method="APPROX", max_rec_depth=12, filter_ratio=1.0), dict(method="EPSILON_GUARANTEED")):
        assert lists(knn_join(fq, again, 5, "pivot", PivotConfig(pivot_count=12, groups=3, **more))) == brute(q, s, 5)
    built = PivotJoin(fq, frame(spark, s), 6, PivotConfig(static_count=3, groups=3), s[:12])
    kept = lambda df: sorted(tuple(map(str, r)) for r in df.where("is_database").select("pivot_id", "min_dist", "max_dist", "n", "size", "smallest", "static_low", "static_high").collect())
    assert kept(again.cells()) == kept(built.cells())
    # what a writer left that did not come to an end is not seen, and overwritten
    (tmp_path / "index" / "objects" / "version=3").mkdir()
    assert again.versions == [0, 1, 2] and again.append(frame(spark, s[:1], 999)) == 3 and again.objects().count() == 401
    with pytest.raises(ValueError, match="neighbours"):
        knn_join(fq, again, 7, "pivot", PivotConfig(groups=3)).count()


def test_crowded_groups_alone_are_copied(spark, monkeypatch):
    rows = frame(spark, data(1, 40)).withColumn("g", F.when(F.col("key") < 30, "hot").otherwise(F.col("key").cast("string")))
    assert topk.crowded(rows, rows, 100) is None
    assert [tuple(r) for r in topk.crowded(rows, rows, 8).collect()] == [("hot", 4, 1)]
    assert [tuple(r) for r in topk.crowded(rows, rows, 40, 7).collect()] == [("hot", 1, 5)]
    q, s = data(24, 60, 3), data(25, 80, 3)
    wide = LshConfig(tables=2, functions=1, w=1e6, multiplier=1)
    for few in (100, 0):
        monkeypatch.setattr(topk, "FEW", few)
        monkeypatch.setattr(lsh, "crowded", lambda q, s: topk.crowded(q, s, 9, 13))
        assert lists(knn_join(frame(spark, q), frame(spark, s), 4, "lsh", wide)) == brute(q, s, 4)


def test_groups_by_a_plain_version():
    """Far-apart seeds, then the lightest group takes its nearest free cell, by loops."""
    rng = np.random.default_rng(5)
    for _ in range(10):
        p, weight, n = rng.standard_normal((18, 3)).astype(np.float32), rng.integers(0, 20, 18), 4
        d = L2().all_pairs(p, p).astype(float)
        seeds = [max(range(18), key=lambda i: (d[i].sum(), -i))]
        while len(seeds) < n:
            seeds.append(max((i for i in range(18) if i not in seeds), key=lambda i: (sum(d[i][x] for x in seeds), -i)))
        groups = [[x] for x in seeds]
        free = [i for i in range(18) if i not in seeds]
        while free:
            g = min(range(n), key=lambda i: (sum(weight[x] for x in groups[i]), i))
            x = min(free, key=lambda i: (sum(d[i][c] for c in groups[g]), i))
            groups[g].append(x)
            free.remove(x)
        got = pivots.grouped(p, weight, n)
        assert [sorted(np.flatnonzero(got == g).tolist()) for g in range(n)] == [sorted(g) for g in groups]


def test_frames_of_the_plan(spark):
    plan = PivotJoin(frame(spark, data(1, 10)), frame(spark, data(2, 60)), 3, PivotConfig(pivot_count=6, static_count=2, groups=3))
    assert [r.pivot for r in plan.static_frame().orderBy("static").collect()] == plan.static.tolist()
    low = plan.lower_bounds(plan.groups, 1.0)
    assert {(r.pivot, r.group_id): r.lower_bound for r in plan.lower_bound_frame().collect()} == {(p, g): low[p, g] for p in range(6) for g in range(3)}
    made = hashing.generated(3, 2, 4, 5.0, np.zeros(3), np.ones(3), 1)
    rows = hashing.frame(spark, made).collect()
    assert len(rows) == 8 and all(made.a[r.table_id, r.function_id].tolist() == r.a and made.b[r.table_id, r.function_id] == r.b for r in rows)


def test_job_metrics(spark):
    with measured(spark) as found:
        spark.range(1000).selectExpr("id % 7 as g").groupBy("g").count().collect()
    values = {r.metric: r.value for r in found.frame().collect()}
    assert values["stages"] >= 1 and values["tasks"] >= 2 and values["shuffleWriteBytes"] > 0 and values["executorCpuTime"] > 0
    with measured(spark) as nothing:
        pass
    assert set(nothing.values.values()) == {0}


def test_counters(spark):
    plan = PivotJoin(frame(spark, data(1, 10)), frame(spark, data(2, 60)), 3, PivotConfig(pivot_count=6, static_count=2, groups=3))
    plan.result().collect()
    assert plan.observed["db_replications"].get["n"] >= 60 and 0 < plan.observed["distance_computations"].get["n"]


def test_grouping_is_balanced_and_total():
    p = data(9, 30, 2)
    g = pivots.grouped(p, np.ones(30), 5)
    assert sorted(np.bincount(g)) == [6] * 5
    with pytest.raises(ValueError):
        pivots.grouped(p, np.ones(30), 31)
    assert len(pivots.static_pivots(p, 4)) == 4
    assert all(i in r for i, r in enumerate(pivots.reverse_nearest(p, 3)))


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 9))
def test_zorder_inverse_and_order(seed, dim):
    c = np.random.default_rng(seed).integers(0, 2**31, (8, dim))
    z = zorder.encode(c)
    assert (zorder.decode(z, dim) == c).all()
    as_int = [int("".join(str(int(x) >> b & 1) for b in range(31, -1, -1) for x in row), 2) for row in c]
    assert [int.from_bytes(v, "big") for v in z] == as_int
    assert zorder.least(dim) <= min(z) and max(z) <= zorder.greatest(dim)


def test_curve_joins(spark):
    q, s = data(10, 20, 3), data(11, 150, 3)
    want, fq, fs = brute(q, s, 4), frame(spark, q), frame(spark, s)
    base = dict(shifts=3, range=1000, scale=1000.0)
    assert lists(knn_join(fq, fs, 4, "curve", CurveConfig(**base, partitions=1))) == want
    for more in (dict(partitions=3), dict(partitions=3, entire_buckets=False), dict(partitions=1, entire_buckets=False), dict(partitions=2, entire_buckets=False, only_zorder=True), dict(partitions=3, curve="hilbert"), dict(partitions=2, entire_buckets=False, curve="hilbert")):
        got = lists(knn_join(fq, fs, 4, "curve", CurveConfig(**base | more)))
        assert set(got) == set(want)
        assert np.mean([len({k for _, k in got[i]} & {k for _, k in want[i]}) / 4 for i in want]) > 0.5
    with pytest.raises(ValueError):
        knn_join(fq, fs, 4, "curve", CurveConfig(scale=1e9))


def test_windows_do_not_depend_on_ranges(spark):
    q, s = data(30, 25, 3), np.concatenate([data(31, 140, 3), np.zeros((30, 3), np.float32)])  # many at one place
    fq, fs = frame(spark, q), frame(spark, s)
    base = dict(shifts=3, range=1000, scale=1000.0, entire_buckets=False)
    want = lists(knn_join(fq, fs, 4, "curve", CurveConfig(**base, partitions=1)))
    for more in (dict(partitions=2), dict(partitions=9), dict(partitions=60), dict(partitions=1, range_objects=11)):
        assert lists(knn_join(fq, fs, 4, "curve", CurveConfig(**base, **more))) == want
    wide = lists(knn_join(fq, fs, 4, "curve", CurveConfig(**base, partitions=9, reach=50)))
    assert wide == brute(q, s, 4)


def test_ranges_of_sketches(spark):
    values = np.empty(100, object)
    values[:] = [bytes([0, 0, 0, i]) for i in range(1, 101)]
    s = (values, np.arange(1, 101))
    assert [z[3] for z in curve.boundaries(s, 4)] == [25, 50, 75]
    found = curve.ranges(s, s, 4, 10, 1)
    assert [(a[3], b[3]) for a, b, _, _ in found][1:3] == [(26, 50), (51, 75)] and found[0][0] == b"\0" * 4 and found[-1][1] == b"\xff" * 4
    assert [(a[3], b[3]) for _, _, a, b in found][1:3] == [(15, 59), (40, 84)]
    none = (np.empty(0, object), np.empty(0, int))
    assert curve.ranges(none, none, 3, 5, 1) == [(b"\0" * 4, b"\xff" * 4) * 2]
    frame_ = curve.range_frame(spark, {0: found})
    assert frame_.columns == ["shift", "part", "q_start", "q_end", "s_start", "s_end"] and frame_.count() == 4


@pytest.mark.parametrize("kind", ["even", "sorted", "skewed"])
def test_sketches_merge_and_bound_ranks(spark, kind):
    """Over many tasks, in any order, with half of the values in a thousandth of the space: ranges have the size they should have."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**40, 60_000) if kind != "skewed" else np.where(rng.random(60_000) < 0.5, rng.integers(0, 2**30, 60_000), rng.integers(0, 2**40, 60_000))
    x = np.sort(x) if kind == "sorted" else x
    df = spark.createDataFrame([(i % 2, int(v).to_bytes(8, "big")) for i, v in enumerate(x)], "shift int, z binary").repartitionByRange(16, "z")
    for shift, (values, upto) in quantiles.sketches(df, "shift", "z", 200).items():
        own = np.sort(x[shift::2])
        assert upto[-1] == len(own) and len(values) < 5 * 200
        cuts = np.array([int.from_bytes(z, "big") for z in curve.boundaries((values, upto), 10)])
        sizes = np.diff(np.concatenate([[0], np.searchsorted(own, cuts, "right"), [len(own)]]))
        assert len(cuts) == 9 and sizes.max() <= len(own) * (0.1 + 2 * quantiles.rank_error(200))
        assert quantiles.ranks_of(values, upto, np.array([bytes(values[0]), None], object)[:-1])[0] == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6))
def test_hilbert_curve(seed, dim):
    """Back again, and one step along the curve is one step in space; small cubes in the order of a plain version."""
    c = np.random.default_rng(seed).integers(0, 2**32, (6, dim))
    index = hilbert.encode(c)
    assert (hilbert.decode(index, dim) == c).all()
    after = [(int.from_bytes(z, "big") + 1).to_bytes(len(z), "big") for z in index if z != b"\xff" * len(z)]
    assert (np.abs(hilbert.decode(after, dim) - c[: len(after)]).sum(1) == 1).all()
    cube = np.stack(np.meshgrid(*[np.arange(2)] * dim, indexing="ij"), -1).reshape(-1, dim)
    assert sorted(int.from_bytes(z, "big") for z in hilbert.encode(cube)) == list(range(2**dim))


def test_curve_window_with_few_objects(spark):
    got = lists(knn_join(frame(spark, [[0.0], [9.0]]), frame(spark, [[1.0], [2.0], [3.0]]), 5, "curve", CurveConfig(shifts=1, range=10, scale=10.0, partitions=1, entire_buckets=False)))
    assert [[k for _, k in got[i]] for i in (0, 1)] == [[0, 1, 2], [2, 1, 0]]


def test_quantized_metric():
    assert L2Quantized(10.0).rows(np.array([[10, 0]]), np.array([[40, 40]]))[0] == pytest.approx(5.0)


def test_lsh(spark):
    q, s = data(12, 30, 4), data(13, 200, 4)
    want = brute(q, s, 3)
    wide = LshConfig(tables=2, functions=2, w=1e6)
    assert lists(knn_join(frame(spark, q), frame(spark, s), 3, "lsh", wide)) == want
    got = lists(knn_join(frame(spark, q), frame(spark, s), 3, "lsh", LshConfig(tables=8, functions=2, w=3.0)))
    assert np.mean([len({k for _, k in got.get(i, [])} & {k for _, k in want[i]}) / 3 for i in want]) > 0.8
    flat = s.copy()
    flat[:, 1] = 7  # a dimension without spread
    tables = lsh.tables_for(frame(spark, flat), LshConfig(tables=1, functions=2, w=1.0, multiplier=1))
    assert len({tuple(x[0]) for x in tables.signatures(flat).tolist()}) > 3
    df = frame(spark, s).select("key", F.array(*[tables.column(F.col("vector"), 0)]).alias("sig"))
    assert [r.sig[0] for r in df.orderBy("key").collect()] == tables.signatures(s)[:, 0].tolist()
    assert hashing.widest(tables, np.array([1.0, 2.0]), 1, 1).b[0, 0] == tables.b[0, 1]


def test_evaluation(spark):
    q, s = data(14, 10), data(15, 60)
    exact = knn_join(frame(spark, q), frame(spark, s), 4)
    r = evaluate.precision_eval(exact, exact, "eq").where("k = 4").first()
    assert (r.precision_avg, r.distance_ratio_min, r.effective_error_max, r.avg_effective_error_avg, r.distance_diff_max) == (1, 1, 1, 1, 0) and len(r) == 16
    part = exact.where("query_key < 5")
    assert evaluate.precision_eval(exact, part).where("k = 1").first().precision_avg == 0.5
    assert evaluate.set_relations(exact, part, "ge").count() == 0 and evaluate.set_relations(exact, part, "le").count() == 5
    with pytest.raises(ValueError):
        evaluate.precision_eval(exact, part, "eq")
    assert evaluate.kth_distance_stats(exact, 4).first().max_dist == pytest.approx(max(v[-1][0] for v in lists(exact).values()))


def test_histograms(spark):
    rows = frame(spark, [[0.0], [1.0], [3.0]])
    assert [(round(r.step, 3), r["count"]) for r in profile.distance_histogram(rows, 1.0, bins=4).collect()] == [(1.0, 1), (2.0, 1), (2.5, 1)]
    assert profile.distance_histogram(rows.limit(1), 1.0).count() == 0
    v = spark.createDataFrame([(float(x),) for x in range(11)], "v double")
    assert sum(r["count"] for r in evaluate.histogram(v, "v", 5).collect()) == 11


def test_cost_and_centroids_by_a_plain_version(spark):
    v, c = data(40, 50, 3), data(41, 7, 3)
    rows = frame(spark, v)
    d = ((v[:, None].astype(float) - c[None].astype(float)) ** 2).sum(-1)
    assert [r.cluster for r in kmeans.assign_centroid(rows, c).orderBy("key").collect()] == d.argmin(1).tolist()
    r = kmeans.cost(rows, c).first()
    assert r.n == 50 and r.cost == pytest.approx(d.min(1).sum())
    assert kmeans.assign_centroid(rows.limit(0), c).count() == 0


def test_kmeans(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, "|x", [float(i % 2 * 10 + i / 100), 0.0]) for i in range(60)], "id int, coords string, vector array<double>")
    found = kmeans.bag_of_words(rows, 2, str(tmp_path / "km"), extended=True)
    assert sorted(round(c[0]) for c in found.centroids) == [0, 10] and found.cost > 0
    assert spark.read.text(str(tmp_path / "km/histograms")).count() == 3 and spark.read.text(str(tmp_path / "km/centroids")).count() == 2
    assert spark.read.text(str(tmp_path / "km/objects_centroids")).first().value[1:4] == "|x;"
    kmeans.bag_of_words(rows, 2, str(tmp_path / "plain"), partitions=3)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "plain")).collect())[0].startswith("0;10.0;10.0")


def test_sweep_shares_its_work(spark, monkeypatch):
    """The database is assigned once for each number of pivots, whatever runs together, and the rows are the same."""
    made = []
    monkeypatch.setattr(pivot_index, "assigned", lambda *args: made.append(args) or pivots.assigned(*args))
    config = SweepConfig((6, 9), (2,), (2,), (1, 3), (0.5,), ("EXACT", "APPROX"))
    q, s = frame(spark, data(1, 8)), frame(spark, data(2, 60))
    told = lambda rows: sorted(tuple(r) for r in rows.drop("seconds").collect())
    one, four = told(sweep(q, s, config)), told(sweep(q, s, config, together=4))
    assert len(made) == 4 and one == four and len(one) == 2 * 2 * 2 * 2
    want = max(x[-1][0] for x in brute(data(1, 8), data(2, 60), 2).values())
    assert all(r[1] == pytest.approx(want) for r in one if r[2] == "EXACT" and r[0] == "MAX")


def test_matches_by_a_plain_version():
    """One walk counts, for every k, what a walk over the first k of both lists finds."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 12))
        lists_ = [(rng.permutation(15)[:n].tolist(), np.sort(rng.integers(0, 6, n).astype(float))) for _ in range(2)]
        (bk, bd), (ck, cd) = lists_
        for k in range(1, n + 1):
            j = common = 0
            for key, d in zip(bk[:k], bd[:k]):
                while j < k and cd[j] <= d and not (ck[j] == key or abs(cd[j] - d) < 2.0**-23):
                    j += 1
                if j < k and (ck[j] == key or abs(cd[j] - d) < 2.0**-23):
                    common, j = common + 1, j + 1
            assert evaluate._matches(bk, bd, ck, cd)[k - 1] == common


def test_sweep(spark, tmp_path):
    config = SweepConfig.of("5;500", "2", "3", "1;2", "0.5", "exact;approx;approx_bounds")
    rows = sweep(frame(spark, data(1, 6)), frame(spark, data(2, 40)), config)
    assert rows.count() == 2 * 3 * 2 * 2 and {r.stat for r in rows.collect()} == {"AVG", "MAX"}
    append_csv(rows, str(tmp_path / "s"))
    append_csv(rows, str(tmp_path / "s"))
    assert spark.read.csv(str(tmp_path / "s"), sep=";").count() == 48


def test_sweep_has_no_rows_of_failures(spark, monkeypatch):
    """Where one of several combinations fails, the sweep has no result."""

    def fails(results, k):
        if k == 3:
            raise RuntimeError("no distances")
        return evaluate.kth_distance_stats(results, k)

    monkeypatch.setattr(sweep_module, "kth_distance_stats", fails)
    with pytest.raises(RuntimeError, match="no distances"):
        sweep(frame(spark, data(1, 6)), frame(spark, data(2, 40)), SweepConfig((5,), (2, 3), (3,), (1,), (0.5,), ("EXACT",)))


def test_stream(spark, tmp_path):
    s = frame(spark, data(2, 40))
    frame(spark, data(1, 6)).write.parquet(str(tmp_path / "q"))
    from simjoin.streaming.knn import knn_stream

    writer = knn_stream(spark.readStream.schema(TYPE).parquet(str(tmp_path / "q")), s, 3, str(tmp_path / "out"))
    run = writer.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 18


def test_shipped_to_workers(tmp_path):
    """From another folder, workers do not find the package unless it is shipped."""
    code = f"""
import sys
sys.path.append({str(Path(__file__).resolve().parents[1])!r})
from pyspark.sql import SparkSession
from simjoin.plans.knn import knn_join
from simjoin.plans.ship import ship
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
ship(spark)
rows = spark.createDataFrame([(i, 0, [float(i)]) for i in range(9)], "key long, classification int, vector array<float>")
print("FOUND", knn_join(rows, rows, 2).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "FOUND 18" in out.stdout, out.stderr[-2000:]


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        knn_join(frame(spark, [[1.0]]), frame(spark, [[1.0]]), 1, "other")


def test_distances_in_blocks(spark):
    s = data(3, 50, 4)
    want = sorted(L2().all_pairs(s, s)[np.tril_indices(50, -1)].tolist())
    for block in (1_000, 7):
        assert sorted(r.distance for r in profile.distances(frame(spark, s), block=block).collect()) == pytest.approx(want)


@pytest.mark.parametrize("n", [1, 3, 400])
def test_distances_of_candidates_are_bounded(monkeypatch, n):
    """However many queries meet however few objects, also where all of these are equally near, few vectors are laid out at a time."""
    laid = []
    monkeypatch.setattr(metric, "PAIRS", 4_096)
    monkeypatch.setattr(L2, "rows", lambda self, x, y, rows=L2.rows: laid.append(x.size) or rows(self, x, y))
    q, s = data(70, 900, 16), np.repeat(data(71, -(-n // 4), 16), 4, 0)[:n]
    i, j, d = block_topk(L2(), q, s, 3)
    assert 0 < max(laid) <= 4_096
    want = brute(q, s, 3)
    assert sorted(zip(i.tolist(), d.tolist(), j.tolist())) == [(x, *pair) for x in want for pair in want[x]]


@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e-18, 1e17])
@pytest.mark.parametrize("at", [0.0, 300.0])
def test_products_miss_no_neighbour(scale, at):
    """Vectors far from the origin, of very small and very large numbers, with and without a limit that others have set."""
    q, s = (((data(seed, n, 24) + at) * scale).astype(np.float32) for seed, n in ((72, 60), (73, 700)))
    s[:60] = q
    want = brute(q, s, 5)
    for limit in (np.full(60, np.inf, np.float32), np.array([want[x][-1][0] for x in want], np.float32)):
        found = {}
        for i, j, d in metric.near_pairs(L2(), q, s, limit, 5):
            for x in zip(i.tolist(), d.tolist(), j.tolist()):
                found.setdefault(x[0], []).append(x[1:])
        assert {x: sorted(y)[:5] for x, y in found.items()} == want

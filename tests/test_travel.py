"""The pivot join of large databases: queries travel, objects do not."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.cloudpickle import dumps

from simjoin.functions.metric import L2, block_topk
from simjoin.operators import travel
from simjoin.operators.pivot_join import PivotJoin
from simjoin.plans.config import PivotConfig
from tests.test_joins import L1, brute, data, frame, lists

SMALL = dict(pivot_count=15, static_count=3, groups=4, travel_objects=0)


@pytest.mark.parametrize("options", [{}, dict(method="EPSILON_GUARANTEED"), dict(method="EPSILON_APPROX"), dict(method="APPROX", max_rec_depth=15, filter_ratio=1.0), dict(method="QUERY_REP", max_rec_depth=15, filter_ratio=1.0), dict(static_count=0)])
@pytest.mark.parametrize("tied", [False, True])
def test_all_neighbours_without_copies(spark, monkeypatch, options, tied):
    """Small parts, balls and batches; each object moves once a round, however many groups may need it."""
    for name, n in (("HELD", 60), ("TOGETHER", 7), ("LEAF", 5), ("FAN", 3)):
        monkeypatch.setattr(travel, name, n)
    q, s = data(61, 70, 3, tied=tied), data(62, 600, 3, tied=tied)
    plan = PivotJoin(frame(spark, q), frame(spark, s), 6, PivotConfig(**SMALL | options))
    assert lists(plan.result()) == brute(q, s, 6)
    assert plan.observed["db_replications"].get["n"] == len(s)


def test_other_metrics_empty_cells_and_few_objects(spark):
    q, s = data(63, 40, 4), data(64, 200, 4)
    d = L1().all_pairs(q, s)
    want = {i: sorted((float(x), j) for j, x in enumerate(row))[:5] for i, row in enumerate(d)}
    assert lists(PivotJoin(frame(spark, q), frame(spark, s), 5, PivotConfig(**SMALL), metric=L1()).result()) == want
    far = np.concatenate([s[:5], s[:3] + 50]).astype(np.float32)  # cells without objects
    assert lists(PivotJoin(frame(spark, np.concatenate([q, far])), frame(spark, s), 5, PivotConfig(**SMALL), far).result()) == brute(np.concatenate([q, far]), s, 5)
    assert lists(PivotJoin(frame(spark, q), frame(spark, s[:3]), 5, PivotConfig(**SMALL)).result()) == brute(q, s[:3], 5)


def test_many_copies_and_epsilon(spark):
    s = np.concatenate([np.repeat(data(65, 3, 3), 300, 0), data(66, 300, 3)])
    q = np.concatenate([s[::100], data(67, 20, 3)])
    assert lists(PivotJoin(frame(spark, q), frame(spark, s), 6, PivotConfig(**SMALL)).result()) == brute(q, s, 6)
    want = brute(q, s, 6)
    got = lists(PivotJoin(frame(spark, q), frame(spark, s), 6, PivotConfig(**SMALL, method="EPSILON_GUARANTEED", epsilon=1.5)).result())
    assert all(len(got[i]) == 6 and all(d <= 1.5 * e + 1e-5 for (d, _), (e, _) in zip(got[i], want[i])) for i in want)


def test_groups_may_be_fixed(spark):
    """Queries whose SQL has so many groups have them over a table of any size."""
    groups = lambda n: len(set(PivotJoin(frame(spark, data(68, 20)), frame(spark, data(69, 90)), 3, PivotConfig(pivot_count=12, static_count=2, groups=4, group_objects=n)).groups.tolist()))
    assert (groups(10), groups(None)) == (9, 4)


def test_parts_of_cells_hold_bounded_numbers(spark, monkeypatch):
    """Of long vectors a task holds fewer."""
    n = np.array([0, 1, 100_000, 100_001, 250_001, 600_000])
    assert travel.parts_of(n, 64).tolist() == [1, 1, 1, 2, 3, 6] and travel.parts_of(n, 4).tolist() == [1, 1, 1, 1, 2, 3]
    assert travel.parts_of(n[:2], 10**8).tolist() == [1, 1]
    monkeypatch.setattr(travel, "NUMBERS", 160)
    q, s = data(74, 30, 8), data(75, 300, 8)
    made = []
    monkeypatch.setattr(travel, "Routes", lambda *args, kind=travel.Routes: made.append(kind(*args)) or made[-1])
    plan = PivotJoin(frame(spark, q), frame(spark, s), 5, PivotConfig(**SMALL))
    assert lists(plan.result()) == brute(q, s, 5)
    assert (made[0].parts * 20 >= plan.voronoi.db_n).all() and made[0].parts.max() > 1


def _asked(s, q, k, limit):
    rows = pa.table({"key": pa.array(range(len(s)), pa.int64()), "classification": pa.array([0] * len(s), pa.int32()), "vector": pa.array(list(s), pa.list_(pa.float32()))})
    return travel._Asked(travel.Cell(rows, k, L2()), q, limit, k, 1.0)


@pytest.mark.parametrize("dim", [40, 2])
@pytest.mark.parametrize("limited", [False, True])
def test_balls_are_met_whole_where_most_is_needed(monkeypatch, dim, limited):
    """Where no ball can be left out a cell is one block, else few objects are met; no object twice."""
    q, s = data(76, 50, dim), data(77, 6_000, dim)
    want, met = brute(q, s, 5), []
    monkeypatch.setattr(travel, "near_pairs", lambda metric, x, y, *more, f=travel.near_pairs: met.append(len(x) * len(y)) or f(metric, x, y, *more))
    asked = _asked(s, q, 5, np.array([want[i][-1][0] for i in want]) if limited else np.full(50, np.inf))
    assert {i: [(float(d), int(j)) for d, j in zip(asked.d[i], asked.at[i])] for i in want} == want
    if dim == 2:
        assert sum(met) < 0.2 * len(q) * len(s)
    else:
        assert sum(met) <= len(q) * len(s) and (not limited or len(met) == 1)


def test_few_parts_are_visited_and_objects_move_in_blocks(spark):
    """Parts are rings, equal vectors are of one, and a row that moves holds the objects of a part that a task finds."""
    s = np.concatenate([data(78, 500, 3), np.repeat(data(79, 1, 3), 300, 0)])
    plan = PivotJoin(frame(spark, s[:5]), frame(spark, s), 5, PivotConfig(**SMALL))
    v, parts = plan.voronoi, np.full(len(plan.pivots), 4)
    routes = travel.Routes(v, plan.static, parts, 1.0, plan.groups, None, None, travel.rings(travel.placed(frame(spark, s), v), parts))
    _, cell, d = block_topk(L2(), s, v.pivots, 1)
    part = routes.part(cell, d.astype(np.float64), s)
    assert len(set(part[500:].tolist())) == 1 and np.bincount(part[:500], minlength=4).min() > 50
    i, c, to = routes.of(s, cell, np.zeros(len(s), np.float32))
    assert set(zip(range(len(s)), cell.tolist(), part.tolist())) <= set(zip(i.tolist(), c.tolist(), to.tolist()))
    assert len(np.flatnonzero(i < 500)) < 2 * 500
    schema = frame(spark, s).limit(0).toArrow().schema
    blocks = travel._blocks(frame(spark, s).coalesce(1), spark.sparkContext.broadcast(dumps(routes)), schema).collect()
    assert sum(b.n for b in blocks) == len(s) and len(blocks) <= 4 * len(v.pivots)
    rows = [(b.cell, b.part, x) for b in blocks for x in pa.ipc.read_record_batch(pa.py_buffer(b.block), schema).column("key").to_pylist()]
    keys = frame(spark, s).select("key").toArrow().column("key").to_pylist()
    assert sorted(rows, key=str) == sorted(zip(cell.tolist(), part.tolist(), keys), key=str)


def test_lists_of_a_query_are_merged_in_order(spark):
    """Its lists come from many cells; ties go to the smaller key, and null keys are one."""
    rows = [(1, 0, [(5, 0, 1.0), (6, 0, 2.0)]), (1, 0, [(4, 1, 1.0)]), (1, 0, []), (2, 3, [(9, 0, 0.5)]), (None, 0, [(8, 0, 2.0)]), (None, 0, [(7, 0, 1.0)]), (3, 0, [])]
    found = spark.createDataFrame(rows, "query_key long, query_class int, found array<struct<db_key:long,db_class:int,distance:float>>")
    got = {(r.query_key, r["rank"]): (r.db_key, r.distance, r.db_class, r.query_class) for r in travel._in_order(found, 2).collect()}
    assert got == {(1, 1): (4, 1.0, 1, 0), (1, 2): (5, 1.0, 0, 0), (2, 1): (9, 0.5, 0, 3), (None, 1): (7, 1.0, 0, 0), (None, 2): (8, 2.0, 0, 0)}

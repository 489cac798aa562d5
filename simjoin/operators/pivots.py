"""Pivots, Voronoi cells, their statistics and their grouping."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simjoin.functions.metric import L2, Metric, block_topk
from simjoin.operators.topk import matrix


def sampled_pivots(database: DataFrame, n: int, seed: int = 937) -> np.ndarray:
    """n vectors of the database, the first by a hash of the key; fewer if it has fewer."""
    rows = database.select("vector", F.xxhash64("key", F.lit(seed)).alias("h"), "key").orderBy("h", "key").limit(n).select("vector").collect()
    return np.array([r.vector for r in rows], np.float32)


def static_pivots(pivots: np.ndarray, n: int, metric: Metric | None = None) -> np.ndarray:
    """Ids of n far-apart pivots: the first, then again and again the one that is farthest in sum."""
    total, free = np.zeros(len(pivots)), np.ones(len(pivots), bool)
    for _ in range(min(n, len(pivots))):
        nxt = int(np.argmax(np.where(free, total, -1)))
        free[nxt] = False
        total += (metric or L2()).all_pairs(pivots[nxt : nxt + 1], pivots)[0]
    return np.flatnonzero(~free)


def assigned(objects: DataFrame, pivots: np.ndarray, static: np.ndarray, depth: int, metric: Metric | None = None) -> DataFrame:
    """The objects with nearest_pivots and nearest_dists (``depth`` of them) and static_dists.

    The pivots, some thousands at most by the configuration, go to every task.
    """
    if depth > len(pivots):
        raise ValueError(f"{depth} nearest of {len(pivots)} pivots")
    sent, own = objects.sparkSession.sparkContext.broadcast((pivots, static)), metric or L2()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, fixed = sent.value
        for batch in batches:
            near, d, to_static = _to_pivots(own, matrix(batch.column("vector")), centres, fixed, depth)
            lists = lambda a, width, t: pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * np.int32(width)), pa.array(a.ravel(), t))
            more = [lists(near.astype(np.int32), depth, pa.int32()), lists(d, depth, pa.float32()), lists(to_static, len(fixed), pa.float32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "nearest_pivots", "nearest_dists", "static_dists"])

    kind = ", ".join(f"{c} {objects.schema[c].dataType.simpleString()}" for c in ("key", "classification", "vector"))
    return objects.select("key", "classification", "vector").mapInArrow(run, kind + ", nearest_pivots array<int>, nearest_dists array<float>, static_dists array<float>")


def _to_pivots(metric: Metric, vectors: np.ndarray, centres: np.ndarray, fixed: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each vector: its ``depth`` nearest pivots and their distances, one after the other, and its distances to the static ones."""
    _, near, d = block_topk(metric, vectors, centres, depth)
    return near, d, metric.all_pairs(vectors, centres[fixed]) if len(vectors) and len(fixed) else np.empty((len(vectors), len(fixed)), np.float32)


def union_of(database: DataFrame, queries: DataFrame) -> DataFrame:
    return database.withColumn("is_database", F.lit(True)).unionByName(queries.withColumn("is_database", F.lit(False)))


def _summed_up(rows: Iterator[tuple[np.ndarray, ...]], k: int) -> pa.RecordBatch:
    """Statistics of the cells of rows (pivot, distance, size, whether of the database, distances to static pivots)."""
    held: dict[tuple[int, bool], list] = {}  # of each cell: distances of the k nearest, the largest, n, size, ranges
    for pivot, d, size, db, fixed in rows:
        if not len(pivot):
            continue
        order = np.lexsort((d, db, pivot))
        pivot, d, size, db, fixed = pivot[order], d[order], size[order], db[order], fixed[order]
        first = np.flatnonzero(np.concatenate([[True], (pivot[1:] != pivot[:-1]) | (db[1:] != db[:-1])]))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(d)], strict=True):
            cell, (lo, hi) = (int(pivot[a]), bool(db[a])), (fixed[a:b].min(0), fixed[a:b].max(0))
            near, high, n, total, low_s, high_s = held.get(cell, (d[:0], d[a], 0, 0, lo, hi))
            held[cell] = [np.sort(np.concatenate([near, d[a : min(b, a + k)]]))[:k], max(high, d[b - 1]), n + b - a, total + int(size[a:b].sum()), np.minimum(low_s, lo), np.maximum(high_s, hi)]
    found = [(p, s, x[0].tolist(), float(x[0][0]), float(x[1]), x[2], x[3], x[4].tolist(), x[5].tolist()) for (p, s), x in held.items()]
    floats = pa.list_(pa.float32())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate((pa.int32(), pa.bool_(), floats, pa.float32(), pa.float32(), pa.int64(), pa.int64(), floats, floats))], names=["pivot_id", "is_database", "near", "low", "high", "n", "size", "static_low", "static_high"])


SUMS = "pivot_id int, is_database boolean, near array<float>, low float, high float, n long, size long, static_low array<float>, static_high array<float>"


def _merged(parts: DataFrame, k: int, static: int) -> DataFrame:
    smallest = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("smallest")
    each = lambda f, c: F.array(*[f(F.get(c, F.lit(i))) for i in range(static)]).cast("array<float>").alias(c)
    return parts.groupBy("pivot_id", "is_database").agg(F.min("low").alias("min_dist"), F.max("high").alias("max_dist"), F.sum("n").alias("n"), F.sum("size").alias("size"), smallest, each(F.min, "static_low"), each(F.max, "static_high"))


def cell_stats(objects: DataFrame, k: int, static: int = 0) -> DataFrame:
    """Per (pivot_id, is_database): min_dist, max_dist, n, size, the k smallest distances, and ranges of static distances.

    ``size`` is the sum of vector lengths; static_low and static_high bound the distances to
    the ``static`` first static pivots. A task sums up its rows first, so of each cell
    k distances per task are gathered at most, and the objects are read once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = lambda batch: (batch.column(c).to_numpy(zero_copy_only=False) for c in ("pivot_id", "d", "size", "is_database"))
        yield _summed_up(((*numbers(b), matrix(b.column("static_dists"))[:, :static]) for b in batches if len(b)), k)

    rows = objects.select(F.get("nearest_pivots", F.lit(0)).alias("pivot_id"), "is_database", F.get("nearest_dists", F.lit(0)).alias("d"), F.size("vector").cast("long").alias("size"), "static_dists")
    return _merged(rows.mapInArrow(run, SUMS), k, static)


def stats_of(database: DataFrame, queries: DataFrame, pivots: np.ndarray, static: np.ndarray, k: int, metric: Metric | None = None) -> DataFrame:
    """The ``cell_stats`` of both sides, of which only vectors are read: the task that assigns them sums them up."""
    sent, own = database.sparkSession.sparkContext.broadcast((pivots, static)), metric or L2()

    def side(objects: DataFrame, db: bool) -> DataFrame:
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
            for batch in batches:
                vectors = matrix(batch.column("vector"))
                near, d, fixed = _to_pivots(own, vectors, *sent.value, 1)
                yield near, d, np.full(len(vectors), vectors.shape[1]), np.full(len(vectors), db), fixed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield _summed_up(rows(batches), k)

        return objects.select("vector").mapInArrow(run, SUMS)

    return _merged(side(database, True).unionByName(side(queries, False)), k, len(static))


def cut_regions(objects: DataFrame) -> DataFrame:
    """Per (pivot_id, is_database, static): the range of distances to that static pivot."""
    rows = objects.select(F.get("nearest_pivots", F.lit(0)).alias("pivot_id"), "is_database", F.posexplode("static_dists").alias("static", "d"))
    return rows.groupBy("pivot_id", "is_database", "static").agg(F.min("d").alias("min_dist"), F.max("d").alias("max_dist"))


def reverse_nearest(pivots: np.ndarray, depth: int, metric: Metric | None = None) -> list[list[int]]:
    """For each pivot, those that have it among their ``depth`` nearest, themselves included."""
    near = np.argsort((metric or L2()).all_pairs(pivots, pivots), axis=1, kind="stable")[:, :depth]
    out: list[list[int]] = [[] for _ in pivots]
    for p, row in enumerate(near.tolist()):
        for x in row:
            out[x].append(p)
    return out


def grouped(pivots: np.ndarray, weight: np.ndarray, groups: int, metric: Metric | None = None) -> np.ndarray:
    """The group of each cell: far-apart seeds, then the lightest group takes its nearest free cell.

    Near means a small sum of distances to the group's cells. The first seed is the pivot
    with the largest sum of distances to all others.
    """
    if groups > len(pivots):
        raise ValueError(f"{groups} groups of {len(pivots)} pivots")
    d = (metric or L2()).all_pairs(pivots, pivots).astype(np.float64)
    group = np.full(len(pivots), -1)
    seeds, total = [int(np.argmax(d.sum(1)))], np.zeros(len(pivots))
    while len(seeds) < groups:
        total += d[seeds[-1]]
        total[seeds] = -np.inf
        seeds.append(int(np.argmax(total)))
    group[seeds] = np.arange(groups)
    sums, load = d[seeds].copy(), weight[seeds].astype(np.float64)
    for _ in range(len(pivots) - groups):
        g = int(np.argmin(load))
        p = int(np.argmin(np.where(group < 0, sums[g], np.inf)))
        group[p] = g
        load[g] += weight[p]
        sums[g] += d[p]
    return group


@dataclass
class Voronoi:
    """What the driver knows of the cells: one entry per pivot, never one per object."""

    pivots: np.ndarray
    k: int
    db_max: np.ndarray  # -inf for a cell without objects
    query_max: np.ndarray
    query_weight: np.ndarray
    smallest: list[np.ndarray]  # of the database side, up to k
    metric: Metric = field(default_factory=L2)
    db_n: np.ndarray = field(init=False)
    query_n: np.ndarray = field(init=False)
    #: pivots x 2 x static pivots: the least and the greatest distances; the empty range of a cell without objects.
    db_box: np.ndarray = field(init=False)
    query_box: np.ndarray = field(init=False)
    distances: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.distances = self.metric.all_pairs(self.pivots, self.pivots).astype(np.float64)
        self.db_n, self.query_n = (np.zeros(len(self.pivots), np.int64) for _ in range(2))
        self.db_box, self.query_box = (np.empty((len(self.pivots), 2, 0)) for _ in range(2))

    @property
    def db_count(self) -> int:
        return int(self.db_n.sum())

    @staticmethod
    def of(pivots: np.ndarray, stats: DataFrame, k: int, metric: Metric | None = None) -> Voronoi:
        n, rows = len(pivots), stats.collect()
        out = Voronoi(pivots, k, np.full(n, -np.inf), np.full(n, -np.inf), np.zeros(n), [np.empty(0)] * n, metric or L2())
        static = max((len(r.static_low) for r in rows), default=0)
        empty = np.stack([np.full((n, static), np.inf), np.full((n, static), -np.inf)], axis=1)
        out.db_box, out.query_box = empty.copy(), empty.copy()
        for r in rows:
            box = np.array([r.static_low, r.static_high], np.float64).reshape(2, static)
            if r.is_database:
                out.db_n[r.pivot_id], out.db_max[r.pivot_id], out.db_box[r.pivot_id] = r.n, r.max_dist, box
                out.smallest[r.pivot_id] = np.sort(np.array(r.smallest, np.float64))
            else:
                out.query_n[r.pivot_id], out.query_max[r.pivot_id], out.query_weight[r.pivot_id], out.query_box[r.pivot_id] = r.n, r.max_dist, r.size, box
        return out

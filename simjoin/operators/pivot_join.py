"""The join pruned by pivots: exact, bounded by epsilon, or heuristic.

Objects belong to the cell of their nearest pivot, cells to groups of equal load. Objects
(or queries) are copied to the groups that may need them. A group's objects come sorted by
cell and by distance to the pivot and stream past its queries, which hold their nearest
objects so far and cut cells and objects by the distances to pivots that are known already.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.cloudpickle import dumps, loads
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from simjoin.functions.metric import L2, Metric, near_pairs
from simjoin.operators import topk, travel
from simjoin.operators.bounds import SLACK, beyond_plane, cell_upper, group_copies, lower_bounds, query_upper, upper_bounds
from simjoin.operators.pivot_index import PivotIndex
from simjoin.operators.pivots import Voronoi, assigned, cell_stats, cut_regions, grouped, reverse_nearest, sampled_pivots, static_pivots, stats_of, union_of
from simjoin.operators.topk import Nearest, Search, best, crowded, matrix, searched
from simjoin.plans.config import PivotConfig


class PivotJoin:
    """One join's plan: pivots, cells and groups, and the operators that follow from them.

    ``pivots`` fixes the pivots (rows of vectors); else they are sampled. A ``PivotIndex``
    as the database brings pivots, metric, assignments and statistics. ``metric`` is any
    that keeps the triangle inequality. The counters of a run are in ``observed`` after an
    action: db_replications, distance_computations.
    """

    def __init__(self, queries: DataFrame, database: DataFrame | PivotIndex, k: int, config: PivotConfig | None = None, pivots: np.ndarray | None = None, metric: Metric | None = None):
        self.k, self.config = k, config or PivotConfig()
        self.index = database if isinstance(database, PivotIndex) else None
        self.metric = self.index.metric if self.index else metric or L2()
        if self.index:
            self.pivots, self.static = self.index.pivots, self.index.static
        else:
            self.pivots = sampled_pivots(database, self.config.pivot_count, self.config.seed) if pivots is None else np.asarray(pivots, np.float32)
            self.static = static_pivots(self.pivots, self.config.static_count, self.metric)
        if not len(self.pivots):
            raise ValueError("the database is empty")
        self.depth = min(self.config.max_rec_depth, len(self.pivots))
        self._plain = queries, database
        self.queries = assigned(queries, self.pivots, self.static, self.depth, self.metric)
        self._stored = lambda depth: self.index.objects(depth) if self.index else assigned(database, self.pivots, self.static, depth, self.metric)
        self.database = self._stored(self.depth)
        self.observed = {name: Observation(name) for name in ("db_replications", "distance_computations")}
        self._voronoi: Voronoi | None = None

    @property
    def objects(self) -> DataFrame:
        return union_of(self.database, self.queries)

    @property
    def voronoi(self) -> Voronoi:
        """Statistics of at most two rows per pivot come to the driver, once."""
        if self._voronoi is None and self.index:
            self._voronoi = self.index.voronoi(self.queries, self.k)
        elif self._voronoi is None:
            queries, database = self._plain
            self._voronoi = Voronoi.of(self.pivots, stats_of(database, queries, self.pivots, self.static, self.k, self.metric), self.k, self.metric)
        return self._voronoi

    @property
    def groups(self) -> np.ndarray:
        """The group of each cell; their number follows the size of the database, unless it is fixed."""
        n = self.config.groups
        if self.config.group_objects is not None:
            n = max(n, -(-self.voronoi.db_count // self.config.group_objects))
        return grouped(self.pivots, self.voronoi.query_weight, min(n, len(self.pivots)), self.metric)

    def _table(self, rows: list[tuple], schema: str) -> DataFrame:
        return F.broadcast(self.queries.sparkSession.createDataFrame(rows, schema))  # pivots x groups rows at most

    def _own(self, objects: DataFrame, groups: np.ndarray) -> DataFrame:
        table = self._table([(p, str(g)) for p, g in enumerate(groups.tolist())], "pivot int, g string")
        return objects.join(table, F.get("nearest_pivots", F.lit(0)) == F.col("pivot")).drop("pivot")

    def lower_bounds(self, groups: np.ndarray, epsilon: float) -> np.ndarray:
        """cells x groups: from which distance to its pivot on an object is copied to a group."""
        low = lower_bounds(self.voronoi, groups, upper_bounds(self.voronoi, groups, epsilon))
        low[np.arange(len(groups)), groups] = -np.inf  # the bounds count on a group's own objects
        return low

    def lower_bound_frame(self) -> DataFrame:
        """(pivot, group_id, lower_bound), for a look at them."""
        low = self.lower_bounds(groups := self.groups, self.config.epsilon if self.config.variant.startswith("EPSILON") else 1.0)
        rows = [(p, g, float(low[p, g])) for p in range(len(groups)) for g in range(low.shape[1])]
        return self.queries.sparkSession.createDataFrame(rows, "pivot int, group_id int, lower_bound double")

    def static_frame(self) -> DataFrame:
        """(static, pivot): the static pivots in order, for a look at them."""
        return self.queries.sparkSession.createDataFrame(list(enumerate(self.static.tolist())), "static int, pivot int")

    def _by_lower_bound(self, groups: np.ndarray, epsilon: float) -> tuple[DataFrame, dict[int, int]]:
        """Copies that bounds and cut regions leave, and how many objects a group gets at most."""
        upper, regions = upper_bounds(self.voronoi, groups, epsilon), self.config.cut_copies and len(self.static) > 0
        rows, most = [], {}
        for g in range(int(groups.max()) + 1):
            c = group_copies(self.voronoi, groups, g, upper, regions)
            cells = np.flatnonzero(c.needed).tolist()
            most[g] = int(self.voronoi.db_n[cells].sum())
            rows += [(p, str(g), float(c.low[p]), *(x.tolist() for x in c.box[p])) for p in cells]
        table = self._table(rows, "pivot int, g string, bound double, box_low array<double>, box_high array<double>")
        at = lambda c, i: F.get(c, F.lit(i))
        on = (at("nearest_pivots", 0) == F.col("pivot")) & (at("nearest_dists", 0) >= F.col("bound"))
        for i in range(len(self.static)) if regions else ():
            on &= at("static_dists", i).between(at("box_low", i), at("box_high", i))
        return self.database.join(table, on).drop("pivot", "bound", "box_low", "box_high"), most

    def _by_nearest(self, objects: DataFrame, groups: np.ndarray, limits: np.ndarray | None = None) -> DataFrame:
        """Copies for the distinct groups of the nearest pivots, with ``limits`` those within them."""
        limit = np.full(len(groups), np.inf) if limits is None else limits
        table = self._table([(p, str(g), float(x)) for p, (g, x) in enumerate(zip(groups.tolist(), limit, strict=True))], "pivot int, g string, reach double")
        near = objects.withColumn("n", F.explode(F.arrays_zip("nearest_pivots", "nearest_dists")))
        kept = near.join(table, (F.col("n.nearest_pivots") == F.col("pivot")) & (F.col("n.nearest_dists") <= F.col("reach"))).drop("n", "pivot", "reach")
        return kept.dropDuplicates(["key", "g"])

    def upper_bounds(self) -> DataFrame:
        """(query_key, query_class, upper_bound) of the *_BOUNDS methods."""
        v, groups, exact = self.voronoi, self.groups, self.config.variant == "EXACT_BOUNDS"
        everything = np.arange(len(self.pivots))
        reverse = reverse_nearest(self.pivots, len(self.pivots) if exact else self.depth, self.metric)
        cells = {g: everything if exact else np.array(sorted({s for p in np.flatnonzero(groups == g) for s in reverse[p]}), np.int64) for g in range(int(groups.max()) + 1)}
        most, fallback = (len(self.pivots) if exact else self.config.max_buckets), [cell_upper(v, c) if np.isfinite(v.query_max[c]) else np.inf for c in everything]
        sent = self.queries.sparkSession.sparkContext.broadcast(dumps((v, groups, cells, fallback)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v, groups, cells, fallback = loads(sent.value)
            for batch in batches:
                d = v.metric.all_pairs(matrix(batch.column("vector")), v.pivots).astype(np.float64) if len(batch) else []
                own = [x.as_py()[0] for x in batch.column("nearest_pivots")]
                found = [query_upper(v, row, cells[groups[c]], most) for row, c in zip(d, own, strict=True)]
                bound = [b if np.isfinite(b) else fallback[c] for b, c in zip(found, own, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("classification"), pa.array(bound, pa.float64())], names=["query_key", "query_class", "upper_bound"])

        key = self.queries.schema["key"].dataType.simpleString()
        return self.queries.mapInArrow(run, f"query_key {key}, query_class int, upper_bound double")

    def _copied(self, groups: np.ndarray) -> tuple[DataFrame, DataFrame, dict[int, int] | None]:
        kind, epsilon = self.config.variant, self.config.epsilon
        if kind in ("EXACT", "EPSILON_GUARANTEED"):
            return self._own(self.queries, groups), *self._by_lower_bound(groups, 1.0 if kind == "EXACT" else epsilon)
        if kind == "QUERY_REP":
            own = {g: int(self.voronoi.db_n[groups == g].sum()) for g in set(groups.tolist())}
            return self._by_nearest(self.queries, groups), self._own(self.database, groups), own
        limits = None
        if kind == "EPSILON_APPROX":
            v = self.voronoi
            reach = [cell_upper(v, c) / epsilon + v.query_max[c] if np.isfinite(v.query_max[c]) else -np.inf for c in range(len(groups))]
            limits = np.array([x + SLACK * (1 + abs(x)) if np.isfinite(x) else x for x in reach])
        return self._own(self.queries, groups), self._by_nearest(self.database, groups, limits), None

    def replicated(self) -> tuple[DataFrame, DataFrame]:
        """Queries and database with the group of each copy."""
        return self._copied(self.groups)[:2]

    def _order_of_cells(self, groups: np.ndarray) -> DataFrame:
        """(g, turns): in which order a group meets the cells, those near its queries first."""
        rows = []
        for g in range(int(groups.max()) + 1):
            own = (groups == g) & np.isfinite(self.voronoi.query_max)
            far = self.voronoi.distances[own].min(0) if own.any() else np.zeros(len(groups))
            rows.append((str(g), np.argsort(np.argsort(far, kind="stable")).tolist()))
        return self._table(rows, "g string, turns array<int>")

    def _held(self, s: DataFrame, groups: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Of each group: its cells, and how many objects of each it has."""
        if self.config.variant == "QUERY_REP":
            return {g: (cells := np.flatnonzero((groups == g) & (self.voronoi.db_n > 0)), self.voronoi.db_n[cells]) for g in set(groups.tolist())}
        found: dict[int, list[tuple[int, int]]] = {}
        for g, cell, n in s.groupBy("g", "cell").count().collect():  # pivots x groups rows at most
            found.setdefault(int(g), []).append((cell, n))
        return {g: tuple(np.array(x).T) for g, x in found.items()}

    def _shares(self, q: DataFrame, s: DataFrame, groups: np.ndarray, most: dict[int, int] | None) -> DataFrame | None:
        """How many tasks a group is dealt to, by what the statistics tell, else by a count."""
        if most is None or self.config.variant == "QUERY_REP":
            return crowded(q, s)
        asked = {g: int(self.voronoi.query_n[groups == g].sum()) for g in most}
        rows = [(str(g), max(1, -(-asked[g] // topk.QUERIES)), max(1, -(-n // topk.OBJECTS))) for g, n in most.items()]
        rows = [r for r in rows if max(r[1:]) > 1]
        return self._table(rows, "g string, ways int, parts int") if rows else None

    def result(self) -> DataFrame:
        """The long form of the join, or for the *_BOUNDS methods the bounds."""
        kind, groups = self.config.variant, self.groups
        if kind.endswith("_BOUNDS"):
            return self.upper_bounds()
        if self.voronoi.db_count > self.config.travel_objects:
            return self._travelled(groups)
        q, s, most = self._copied(groups)
        one = lambda df: df.withColumns({"cell": F.get("nearest_pivots", F.lit(0)), "dist": F.get("nearest_dists", F.lit(0))})
        q, s = one(q), one(s)
        few = self.config.max_buckets if kind in ("APPROX", "QUERY_REP") else None
        known = Known(self.voronoi, groups, self.config.epsilon if kind.startswith("EPSILON") else 1.0, self.config.exact_parent_filter, kind == "EXACT", few, self._held(s, groups) if few else {})
        shares = self._shares(q, s, groups, most)
        s = s.observe(self.observed["db_replications"], F.count("*").alias("n"))
        s = s.join(self._order_of_cells(groups), "g").withColumn("turn", F.get("turns", F.col("cell")))
        found = searched(q, s, pruned_search(known, self.queries.sparkSession.sparkContext), ["cell", "dist", "static_dists"], ["turn", "cell", "dist"], shares)
        found = found.observe(self.observed["distance_computations"], F.sum("cost").alias("n"))
        return best(found, self.k, repeated=kind == "QUERY_REP")

    def _travelled(self, groups: np.ndarray) -> DataFrame:
        """The join of a large database, see ``operators.travel``: no object is copied.

        As all objects of a cell are at hand, APPROX visits the nearest of all cells and
        EPSILON_APPROX keeps the guarantee; QUERY_REP visits what it does with copies.
        """
        kind = self.config.variant
        few = self.config.max_buckets if kind in ("APPROX", "QUERY_REP") else None
        (queries, database), parts = self._plain, travel.parts_of(self.voronoi.db_n, self.pivots.shape[1])
        if self.index:
            database = self._stored(1).select("key", "classification", "vector", F.get("nearest_pivots", F.lit(0)).alias("cell"), F.get("nearest_dists", F.lit(0)).alias("dist"))
        edges = ()
        if parts.max() > 1:  # where the rings end need not be exact, so one of some objects tells it
            some = database.where(F.pmod(F.xxhash64("key"), F.lit(max(1, travel.HELD // 2_000))) == 0)
            edges = travel.rings(travel.placed(some, self.voronoi), parts)
        routes = travel.Routes(self.voronoi, self.static, parts, self.config.epsilon if kind.startswith("EPSILON") else 1.0, groups, few, self.depth if kind == "QUERY_REP" else None, edges)
        return travel.travelled(queries, database, self.k, routes, self.observed["db_replications"], self.observed["distance_computations"])

    def exclusions(self) -> DataFrame:
        """(query_key, cells, by_difference, by_plane): how many database cells a query's own bound excludes.

        By half the difference of its distances to the two pivots, which any metric allows,
        and by the plane between them, where the metric allows that.
        """
        v = self.voronoi
        sent = self.queries.sparkSession.sparkContext.broadcast(dumps(v))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v = loads(sent.value)
            filled, few, of_few = _few(v, v.db_n > 0)
            for batch in batches:
                if not len(batch):
                    continue
                d = v.metric.all_pairs(matrix(batch.column("vector")), v.pivots).astype(np.float64)
                own = np.array([x.as_py()[0] for x in batch.column("nearest_pivots")])
                r = _kth_reach(d, few, of_few, v.k)[:, None]
                home, other = d[np.arange(len(d)), own][:, None], filled[None] != own[:, None]
                out = [(other & (how(d[:, filled], home, v.distances[own][:, filled]) > r + SLACK * (1 + r))).sum(1) for how in (lambda a, b, _: (a - b) / 2, lambda a, b, c: beyond_plane(v.metric, a, b, c))]
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.full(len(d), len(filled))), *map(pa.array, out)], names=["query_key", "cells", "by_difference", "by_plane"])

        return self.queries.mapInArrow(run, f"query_key {self.queries.schema['key'].dataType.simpleString()}, cells long, by_difference long, by_plane long")

    def cells(self) -> DataFrame:
        return cell_stats(self.objects, self.k, len(self.static))

    def regions(self) -> DataFrame:
        return cut_regions(self.objects)


#: Queries that are compared together, and objects that pass them before their radii are looked at again.
QUERY_BLOCK, OBJECT_BLOCK = 256, 2_048


@dataclass(frozen=True)
class Known:
    """What a search knows of the join: statistics of cells, never of objects."""

    voronoi: Voronoi
    groups: np.ndarray
    epsilon: float
    exact_parent: bool
    everything: bool  # the objects of all cells bound a query's radius, not only those that its group surely has
    most_cells: int | None
    held: dict[int, tuple[np.ndarray, np.ndarray]]


def _few(v: Voronoi, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the cells that a mask names: ids, their least distances one after the other, and whose these are."""
    filled = np.flatnonzero(cells & np.array([len(x) > 0 for x in v.smallest]))
    few = np.concatenate([np.empty(0), *[v.smallest[c] for c in filled]])
    return filled, few, np.repeat(filled, [len(v.smallest[c]) for c in filled])


def _kth_reach(d: np.ndarray, few: np.ndarray, of_few: np.ndarray, k: int) -> np.ndarray:
    """No k-th neighbour is farther than the k-th least way over a pivot."""
    if len(few) < k:
        return np.full(len(d), np.inf)
    return np.concatenate([np.empty(0), *[np.partition(d[at : at + QUERY_BLOCK][:, of_few] + few, k - 1, axis=1)[:, k - 1] for at in range(0, len(d), QUERY_BLOCK)]])


class _Pruned:
    """The queries of one group while its objects pass, cell for cell and by their distance to the pivot.

    A cell is cut by the plane between its pivot and the query's, by its ball, or by its
    ranges of distances to the static pivots, objects by their distance to its pivot. These
    are taken from the rows that are there, so they hold for any part of a cell.
    """

    def __init__(self, q: pa.Table, known: Known):
        v, self.known, self.cost = known.voronoi, known, 0
        column = lambda c: q.column(c).combine_chunks()
        self.vectors, self.static = matrix(column("vector")), matrix(column("static_dists")).astype(np.float64)
        self.home, self.home_dist = column("cell").to_numpy(), column("dist").to_numpy().astype(np.float64)
        group, n = int(q.column("g")[0].as_py()), len(self.vectors)
        self.nearest, self.bound, self.reach = Nearest(n, v.k), np.full(n, np.inf), np.full(n, np.inf)
        _, few, of_few = _few(v, np.ones(len(v.pivots), bool) if known.everything else known.groups == group)
        for at in range(0, n, QUERY_BLOCK):
            d = v.metric.all_pairs(self.vectors[at : at + QUERY_BLOCK], v.pivots).astype(np.float64)
            # unlike a distance that was found, this bound must not be cut by epsilon
            self.bound[at : at + QUERY_BLOCK] = _kth_reach(d, few, of_few, v.k)
            if known.most_cells is not None:
                self.reach[at : at + QUERY_BLOCK] = self._visited(d, *known.held.get(group, (np.empty(0, int), np.empty(0, int))))
        self.cost += n * len(v.pivots)
        self.cell, self.d = -1, np.empty(0)

    def _visited(self, d: np.ndarray, cells: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How far the cells are that each query may visit: so many, and as many more as it takes to meet k objects."""
        if not len(cells):
            return np.full(len(d), np.inf)
        order = np.argsort(d[:, cells], axis=1, kind="stable")
        enough = (np.cumsum(n[order], axis=1) < self.known.voronoi.k).sum(1) + 1
        last = np.minimum(np.maximum(enough, self.known.most_cells), len(cells)) - 1
        rows = np.arange(len(d))
        return d[rows, cells[order[rows, last]]]

    def see(self, objects: pa.RecordBatch) -> None:
        cell, dist = objects.column("cell").to_numpy(), objects.column("dist").to_numpy().astype(np.float64)
        vectors, static = matrix(objects.column("vector")), matrix(objects.column("static_dists")).astype(np.float64)
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(cell)], strict=True):
            for lo in range(a, b, OBJECT_BLOCK):
                self._meet(int(cell[a]), slice(lo, min(b, lo + OBJECT_BLOCK)), dist, vectors, static, objects)

    def _meet(self, c: int, rows: slice, dist: np.ndarray, vectors: np.ndarray, static: np.ndarray, objects: pa.RecordBatch) -> None:
        known, v = self.known, self.known.voronoi
        if c != self.cell:
            self.cell, self.d = c, v.metric.all_pairs(self.vectors, v.pivots[c : c + 1])[:, 0].astype(np.float64)
        d, own, fixed = self.d, dist[rows], static[rows]
        r = np.minimum(self.bound, self.nearest.last)
        slack = SLACK * (1 + np.where(np.isfinite(r), r, 0))
        near = np.minimum(self.bound, self.nearest.last / known.epsilon) + slack
        spared = (self.home != c) & (beyond_plane(v.metric, d, self.home_dist, v.distances[self.home, c]) > near)
        spared |= (d - own[-1] > near) | (own[0] - d > near) | (d > self.reach)
        spared |= (self.static - near[:, None] > fixed.max(0)).any(1) | (self.static + near[:, None] < fixed.min(0)).any(1)
        width = r + slack if known.exact_parent else near
        go = np.flatnonzero(~spared)
        go = go[np.argsort(d[go], kind="stable")]  # queries at one distance from the pivot need one stretch of its objects
        for at in range(0, len(go), QUERY_BLOCK):
            q = go[at : at + QUERY_BLOCK]
            a, b = np.searchsorted(own, (d - width)[q].min()), np.searchsorted(own, (d + width)[q].max(), "right")
            self.cost += len(q) * int(max(0, b - a))
            for i, j, found in near_pairs(v.metric, self.vectors[q], vectors[rows][a:b], np.minimum(self.bound + slack, self.nearest.last)[q], v.k):
                self.nearest.add(q[i], found, rows.start + a + j, objects)


def pruned_search(known: Known, context: SparkContext | None = None) -> Search:
    """The search of a pivot join; with a context, what it knows is broadcast."""
    if context is None:
        return lambda q: _Pruned(q, known)
    sent = context.broadcast(dumps(known))  # as tasks are sent, so that a metric may be defined anywhere
    return lambda q: _Pruned(q, loads(sent.value))


def knn_pivot(queries: DataFrame, database: DataFrame | PivotIndex, k: int, config: PivotConfig | None = None, pivots: np.ndarray | None = None, metric: Metric | None = None) -> DataFrame:
    return PivotJoin(queries, database, k, config, pivots, metric).result()

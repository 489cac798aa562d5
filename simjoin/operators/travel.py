"""The pivot join of a large database: its objects stay in their cells, and queries travel.

Copies of objects follow from bounds of whole cells, which hold for the worst query of each, so
many objects are copied to many groups. Here each object moves once a round. A query is
searched in its own cell first; the distance of its k-th object there is its radius, with
which it goes on to those cells alone that its ball may meet. A task holds the objects of a
cell, or of a part of one, and a bounded number of queries at a time; it cuts objects into
small balls where queries come near. Parts are rings around the pivot, so that a query needs
few of them. Objects move in blocks of those that a task finds for one cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.cloudpickle import dumps, loads
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from simjoin.functions.metric import Metric, block_topk, near_pairs
from simjoin.operators.bounds import SLACK, beyond_plane
from simjoin.operators.pivots import Voronoi
from simjoin.operators.topk import COLUMNS, key_parts, matrix, partitions

#: Objects that a task holds at a time, and numbers of their vectors; cells with more are dealt to several parts.
HELD, NUMBERS = 250_000, 6_400_000
#: Queries that are searched together.
TOGETHER = 20_000
#: Objects of a small ball, and into how many a larger one is cut.
LEAF, FAN = 400, 16
#: Objects, and numbers of their vectors, that a task holds while it makes blocks, and numbers of a block.
BLOCKED, BLOCKED_NUMBERS, BLOCK_NUMBERS = 40_000, 2_500_000, 2_000
#: Quantiles of the distances to a pivot, of which some bound the rings.
GRID = 1_024

OBJECT, QUERY, LIST = 0, 1, 2


@dataclass
class _Ball:
    """Objects within ``radius`` of a centre, which stand one after the other, and smaller balls of them once they are asked for."""

    centre: np.ndarray
    radius: float
    start: int
    stop: int
    inner: list[_Ball] | None = None

    def __len__(self) -> int:
        return self.stop - self.start


class Cell:
    """The objects that a task holds, in the order of their keys; of equal vectors the k least keys, as no other is a neighbour.

    ``placed`` are their vectors ball for ball, ``order`` tells which objects they are.
    """

    def __init__(self, objects: pa.Table, k: int, metric: Metric):
        self.k, self.metric = k, metric
        column = lambda c: objects.column(c).combine_chunks()
        vectors = np.ascontiguousarray(matrix(column("vector")))
        order = np.lexsort(tuple(reversed(key_parts(column("key")))))
        same = np.unique(vectors[order].view(np.dtype((np.void, vectors.shape[1] * 4)))[:, 0], return_inverse=True)[1] if vectors.shape[1] else np.zeros(len(order), int)
        by = np.argsort(same, kind="stable")
        rank = np.empty(len(by), int)
        rank[by] = np.arange(len(by)) - np.searchsorted(same[by], same[by])
        order = order[rank < k]
        self.placed, rows = vectors[order], pa.array(order)
        self.keys, self.classes = column("key").take(rows), column("classification").take(rows)
        self.order, centre = np.arange(len(order)), self.placed[0].copy()
        self.root = _Ball(centre, float(metric.all_pairs(self.placed, centre[None]).max()) * (1 + SLACK), 0, len(order))

    def inner(self, ball: _Ball) -> list[_Ball]:
        """The smaller balls of a ball; none of a small one."""
        if ball.inner is None:
            ball.inner = self._cut(ball) if len(ball) > LEAF else []
        return ball.inner

    def _cut(self, ball: _Ball) -> list[_Ball]:
        n, here = len(ball), slice(ball.start, ball.stop)
        vectors, fan = self.placed[here], min(FAN, -(-4 * n // LEAF))
        centres = vectors[np.linspace(0, n - 1, fan).astype(int)]
        _, near, d = block_topk(self.metric, vectors, centres, 1)
        if (near == near[0]).all():  # nothing to tell them apart by
            near = np.arange(n) * fan // n
            d = self.metric.rows(vectors, centres[near])
        by = np.argsort(near, kind="stable")
        near, d = near[by], d[by].astype(np.float64)
        self.placed[here], self.order[here] = vectors[by], self.order[here][by]
        first = np.flatnonzero(np.concatenate([[True], near[1:] != near[:-1]]))
        radius = np.maximum.reduceat(d, first) * (1 + SLACK)
        return [_Ball(centres[near[lo]], r, ball.start + lo, ball.start + hi) for r, lo, hi in zip(radius.tolist(), first.tolist(), [*first[1:].tolist(), n], strict=True)]


class _Asked:
    """Queries and their k nearest objects of one cell; none is farther than the ``limit`` that a query brings."""

    def __init__(self, cell: Cell | None, vectors: np.ndarray, limit: np.ndarray, k: int, epsilon: float):
        self.cell, self.vectors, self.limit, self.epsilon, self.cost = cell, vectors, limit.astype(np.float32), epsilon, np.zeros(len(vectors), np.int64)
        self.d, self.at = np.full((len(vectors), k), np.inf, np.float32), np.full((len(vectors), k), -1)
        if cell is not None and len(vectors):
            everyone, self.first = np.arange(len(vectors)), np.full(len(vectors), -1)
            if len(free := np.flatnonzero(np.isinf(self.limit))):
                self._nearest_leaf(cell.root, free)
            self._within(cell.root, everyone)

    def last(self, q: np.ndarray) -> np.ndarray:
        return np.minimum(self.limit[q], self.d[q, -1])

    def near(self, q: np.ndarray) -> np.ndarray:
        """How near something has to be to change a list by more than the factor epsilon."""
        last = self.last(q).astype(np.float64) / self.epsilon
        return last + SLACK * (1 + np.where(np.isfinite(last), last, 0))

    def _apart(self, inner: list[_Ball], q: np.ndarray) -> np.ndarray:
        self.cost[q] += len(inner)
        return self.cell.metric.all_pairs(self.vectors[q], np.stack([b.centre for b in inner])).astype(np.float64)

    def _nearest_leaf(self, ball: _Ball, q: np.ndarray) -> None:
        """A first radius."""
        inner = self.cell.inner(ball)
        if not inner:
            self.first[q] = ball.start
            return self._meet(ball, q)
        child = self._apart(inner, q).argmin(1)
        for i in np.unique(child).tolist():
            self._nearest_leaf(inner[i], q[child == i])

    def _within(self, ball: _Ball, q: np.ndarray) -> None:
        """A query meets a ball whole if its own is not much smaller and needs most of it, unless a part of it was met before; else the smaller balls it needs."""
        fresh, inner = (self.first[q] < ball.start) | (self.first[q] >= ball.stop), self.cell.inner(ball)
        if not inner:
            return self._meet(ball, q[fresh])
        d, radius, n = self._apart(inner, q), np.array([b.radius for b in inner]), np.array([len(b) for b in inner])
        near = self.near(q)
        whole = fresh & (near > ball.radius / 3) & ((d - radius <= near[:, None]) @ n > len(ball) / 2)
        self._meet(ball, q[whole])
        q, d = q[~whole], d[~whole]
        may = d - radius <= near[~whole, None]  # radii only shrink
        for i in np.argsort(d.min(0)).tolist() if len(q) else ():
            if len(go := np.flatnonzero(may[:, i])) and len(go := go[d[go, i] - radius[i] <= self.near(q[go])]):
                self._within(inner[i], q[go])

    def _meet(self, ball: _Ball, q: np.ndarray) -> None:
        if not len(q):
            return
        self.cost[q] += len(ball)
        found = list(near_pairs(self.cell.metric, self.vectors[q], self.cell.placed[ball.start : ball.stop], self.last(q), self.d.shape[1]))
        i, j, d = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(i):
            return
        who, i = np.unique(q[i], return_inverse=True)
        old, rank = np.nonzero(self.at[who] >= 0)
        i, d, j = np.concatenate([old, i]), np.concatenate([self.d[who][old, rank], d]), np.concatenate([self.at[who][old, rank], self.cell.order[ball.start + j]])
        order = np.lexsort((j, d, i))
        i, d, j = i[order], d[order], j[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        keep = rank < self.d.shape[1]
        self.d[who[i[keep]], rank[keep]], self.at[who[i[keep]], rank[keep]] = d[keep], j[keep]


@dataclass(frozen=True)
class Routes:
    """What tells where a query goes: statistics of cells, never of objects."""

    voronoi: Voronoi
    static: np.ndarray
    parts: np.ndarray  # of each cell
    epsilon: float
    groups: np.ndarray
    most_cells: int | None  # that a query may visit, for an approximate search
    depth: int | None  # the groups of so many nearest pivots are visited, each for itself; None: all cells as one group
    edges: tuple[np.ndarray, ...] = ()  # of each cell: distances to its pivot that bound its parts; of none, any part may have any object

    def _may(self, d: np.ndarray) -> np.ndarray:
        """Which cells a query may visit: the nearest ``most_cells``, and as many more as it takes to meet k objects."""
        v = self.voronoi
        out = np.zeros(d.shape, bool)
        groups = np.zeros(len(self.groups), int) if self.depth is None else self.groups
        order = np.argsort(d, axis=1, kind="stable")
        for g in np.unique(groups).tolist():
            cells = np.flatnonzero((groups == g) & (v.db_n > 0))
            who = np.arange(len(d)) if self.depth is None else np.flatnonzero((groups[order[:, : self.depth]] == g).any(1))
            if not len(cells) or not len(who):
                continue
            if self.most_cells is None:
                out[np.ix_(who, cells)] = True
                continue
            nearest = np.argsort(d[np.ix_(who, cells)], axis=1, kind="stable")
            enough = (np.cumsum(v.db_n[cells][nearest], axis=1) < v.k).sum(1) + 1
            last = np.minimum(np.maximum(enough, self.most_cells), len(cells)) - 1
            reach = d[who, cells[nearest[np.arange(len(who)), last]]]
            out[np.ix_(who, cells)] = d[np.ix_(who, cells)] <= reach[:, None]
        return out

    def part(self, cell: np.ndarray, dist: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """The part of each object or query; equal vectors are of one."""
        low, high = self._parts(cell, dist, dist)
        if (low == high).all():
            return low
        bits = np.ascontiguousarray(vectors + np.float32(0)).view(np.uint32).astype(np.uint64)  # of -0 and 0 alike
        h = bits @ (np.arange(1, 2 * vectors.shape[1], 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return low + ((h >> np.uint64(33)).astype(np.int64) % (high - low + 1)).astype(low.dtype)

    def _parts(self, cell: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and the last part of each cell that may have objects between two distances to its pivot."""
        first, last = np.zeros(len(cell), np.int64), self.parts[cell] - 1
        for c in np.unique(cell[last > 0]).tolist() if self.edges else ():
            if len(self.edges[c]):
                rows = np.flatnonzero(cell == c)
                first[rows], last[rows] = np.searchsorted(self.edges[c], low[rows], "left"), np.searchsorted(self.edges[c], high[rows], "right")
        return first, last

    def of(self, vectors: np.ndarray, home: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, cell, part): where objects within ``last`` over epsilon may be."""
        v = self.voronoi
        d = v.metric.all_pairs(vectors, v.pivots).astype(np.float64)
        near = last.astype(np.float64) / self.epsilon
        near = near + SLACK * (1 + np.where(np.isfinite(near), near, 0))
        i, c = np.nonzero(self._cells(d, home, near[:, None]))
        first, last_part = self._parts(c, d[i, c] - near[i], d[i, c] + near[i])
        times = last_part - first + 1
        return np.repeat(i, times), np.repeat(c, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - first, times)

    def _cells(self, d: np.ndarray, home: np.ndarray, near: np.ndarray) -> np.ndarray:
        v = self.voronoi
        own = d[np.arange(len(d)), home][:, None]
        go = (home[:, None] == np.arange(len(v.pivots))) | (beyond_plane(v.metric, d, own, v.distances[home]) <= near)
        go &= (v.db_n > 0) & (d - v.db_max <= near)
        for i, p in enumerate(self.static[: v.db_box.shape[2]].tolist()):
            go &= (d[:, p : p + 1] - near <= v.db_box[:, 1, i]) & (d[:, p : p + 1] + near >= v.db_box[:, 0, i])
        return go if self.most_cells is None and self.depth is None else go & self._may(d)


def parts_of(n: np.ndarray, dim: int) -> np.ndarray:
    """Into how many parts cells of so many objects are dealt, so that a task's memory depends neither on these nor on their vectors' length."""
    return np.maximum(1, -(-n // max(1, min(HELD, NUMBERS // max(1, dim)))))


def rings(places: DataFrame, parts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each cell the distances to its pivot that cut it into ``parts`` of about as many objects, by quantiles of some (cell, dist)."""
    out, cut = [np.empty(0)] * len(parts), np.flatnonzero(parts > 1).tolist()
    if cut:
        quantiles = F.percentile_approx("dist", [i / GRID for i in range(GRID + 1)]).alias("grid")
        for r in places.where(F.col("cell").isin(cut)).groupBy("cell").agg(quantiles).collect():  # a row per cell
            at = np.arange(1, parts[r.cell]) * GRID // parts[r.cell]
            out[r.cell] = np.array(r.grid, np.float64)[at]
    return tuple(out)


def _place(batch: pa.RecordBatch, voronoi: Voronoi, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if "cell" in batch.schema.names:
        return batch.column("cell").to_numpy(), batch.column("dist").to_numpy().astype(np.float64)
    _, cell, d = block_topk(voronoi.metric, vectors, voronoi.pivots, 1)
    return cell.astype(np.int32), d.astype(np.float64)


def placed(rows: DataFrame, voronoi: Voronoi) -> DataFrame:
    """(cell, dist) of objects."""
    if "cell" in rows.columns:
        return rows.select("cell", "dist")
    sent = rows.sparkSession.sparkContext.broadcast(dumps(voronoi))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = loads(sent.value)
        for batch in batches:
            cell, d = _place(batch, v, matrix(batch.column("vector")))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(d)], names=["cell", "dist"])

    return rows.select("vector").mapInArrow(run, "cell int, dist double")


_OBJECT = ["key", "classification", "vector"]


def _dealt(queries: DataFrame, sent: Broadcast) -> DataFrame:
    """The queries with their cell and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = loads(sent.value)
        for batch in batches:
            vectors = matrix(batch.column("vector"))
            cell, d = _place(batch, known.voronoi, vectors)
            more = [pa.array(x, pa.int32()) for x in (cell, known.part(cell, d, vectors))]
            yield pa.RecordBatch.from_arrays([*more, *[batch.column(c) for c in _OBJECT]], names=["cell", "part", *_OBJECT])

    rows = queries.select(*_OBJECT, *[c for c in ("cell", "dist") if c in queries.columns])
    kind = ", ".join(f"{c} {queries.schema[c].dataType.simpleString()}" for c in _OBJECT)
    return rows.mapInArrow(run, f"cell int, part int, {kind}")


def _blocks(database: DataFrame, sent: Broadcast, schema: pa.Schema) -> DataFrame:
    """(cell, part, n, block): n objects of one part of a cell as one value, as a task finds them; a row of each would cost more than its search."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, rows, numbers = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows, numbers = rows + len(batch), numbers + len(batch.column("vector").flatten())
            if rows >= BLOCKED or numbers >= BLOCKED_NUMBERS:
                yield pa.Table.from_batches(held)
                held, rows, numbers = [], 0, 0
        if rows:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = loads(sent.value)
        for table in some(batches):
            batch = table.combine_chunks().to_batches()[0]
            vectors = matrix(batch.column("vector"))
            cell, d = _place(batch, known.voronoi, vectors)
            part = known.part(cell, d, vectors)
            order = np.lexsort((part, cell))
            cell, part = cell[order], part[order]
            first = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])]))
            most = max(1, BLOCK_NUMBERS // max(1, vectors.shape[1]))
            cuts = np.concatenate([np.arange(a, b, most) for a, b in zip(first, [*first[1:], len(cell)], strict=True)])
            n = np.diff(np.append(cuts, len(cell)))
            sorted_ = pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(order)).cast(schema.field(c).type) for c in _OBJECT], schema=schema)
            blocks = pa.array([sorted_.slice(a, b).serialize().to_pybytes() for a, b in zip(cuts.tolist(), n.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(cell[cuts], pa.int32()), pa.array(part[cuts], pa.int32()), pa.array(n, pa.int64()), blocks], names=["cell", "part", "n", "block"])

    rows = database.select(*_OBJECT, *[c for c in ("cell", "dist") if c in database.columns])
    return rows.mapInArrow(run, "cell int, part int, n long, block binary")


def _by_cell(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows), "cell", "part").sortWithinPartitions("cell", "part", "kind")


def _met(batches: Iterator[pa.RecordBatch], k: int, metric: Metric, schema: pa.Schema) -> Iterator[tuple[Cell | None, pa.Table]]:
    """The queries of each cell, a bounded number at a time, with the cell's objects; lists come without."""
    now, objects, queries, held, cell = None, [], [], 0, None
    for batch in batches:
        cells, part, kind = (batch.column(c).to_numpy() for c in ("cell", "part", "kind"))
        first = np.flatnonzero(np.concatenate([[True], (np.diff(cells) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)])) if len(batch) else []
        for lo, hi in zip(first, [*first[1:], len(batch)], strict=True):
            name = (cells[lo], part[lo])
            if queries and (name != now or kind[lo] == LIST or held >= TOGETHER):
                yield cell, pa.Table.from_batches(queries)
                queries, held = [], 0
            if name != now:
                now, objects, cell = name, [], None
            rows = batch.slice(lo, hi - lo)
            if kind[lo] == OBJECT:
                objects += [pa.ipc.read_record_batch(b.as_buffer(), schema) for b in rows.column("block")]
            elif kind[lo] == LIST:
                yield None, pa.Table.from_batches([rows])
            else:
                if objects:
                    cell, objects = Cell(pa.Table.from_batches(objects), k, metric), []
                queries.append(rows)
                held += len(rows)
    if queries:
        yield cell, pa.Table.from_batches(queries)


def _in_order(found: DataFrame, k: int) -> DataFrame:
    """The long form of the k nearest of each query, of its lists (query_key, query_class, found); a list is in order."""
    by_query = found.repartition(partitions(found), "query_key").sortWithinPartitions("query_key")

    def starts(keys: pa.Array) -> np.ndarray:
        """Which keys differ from the one before."""
        if pa.types.is_struct(keys.type):
            return np.logical_or.reduce([starts(x) for x in keys.flatten()])
        x, y = keys[1:], keys[:-1]
        same = pc.or_(pc.fill_null(pc.equal(x, y), False), pc.and_(x.is_null(), y.is_null()))
        return np.concatenate([[True], ~same.to_numpy(zero_copy_only=False)])

    def merged(t: pa.RecordBatch, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        lists = t.column("found")
        n, item = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten()
        row, query = np.repeat(np.arange(len(t)), n), np.repeat(np.cumsum(first) - 1, n)
        names = [f.name for f in item.type]
        key, kind, d = (item.field(names.index(c)) for c in ("db_key", "db_class", "distance"))
        order, several = np.arange(len(row)), np.flatnonzero(np.bincount(query, minlength=1)[query] > n[row]) if len(row) else ()
        if len(several):
            order[several] = several[np.lexsort((*reversed(key_parts(key.take(pa.array(several)))), d.to_numpy()[several], query[several]))]
        rank = np.arange(len(row)) - np.searchsorted(query, query)
        order, rank = order[rank < k], rank[rank < k]
        rows, at = pa.array(row[order]), pa.array(order)
        out = [t.column("query_key").take(rows), t.column("query_class").take(rows), pa.array(rank + 1, pa.int32()), key.take(at), d.take(at), kind.take(at)]
        yield from pa.Table.from_arrays(out, names=COLUMNS).combine_chunks().to_batches(10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the lists of a query, of which the next batch may have more
        for batch in batches:
            if not len(batch):
                continue
            t = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
            first = starts(t.column("query_key"))
            cut = int(np.flatnonzero(first)[-1])
            if cut:
                yield from merged(t.slice(0, cut), first[:cut])
            held = [t.slice(cut)]
        if held:
            yield from merged(held[0], starts(held[0].column("query_key")))

    q_kind, listed = (found.schema[c].dataType for c in ("query_key", "found"))
    return by_query.mapInArrow(run, f"query_key {q_kind.simpleString()}, query_class int, rank int, db_key {listed.elementType['db_key'].dataType.simpleString()}, distance float, db_class int")


def travelled(queries: DataFrame, database: DataFrame, k: int, routes: Routes, moved: Observation | None = None, computed: Observation | None = None) -> DataFrame:
    """The long form of the k nearest objects of each query in the cells that it visits.

    Both sides have key, classification and vector; those that are assigned already also
    cell and dist. An object is in one cell, so no pair comes twice. ``moved`` counts the
    objects of a round, ``computed`` distances.
    """
    spark, metric, epsilon = queries.sparkSession, routes.voronoi.metric, routes.epsilon
    sent = spark.sparkContext.broadcast(dumps(routes))
    schema = spark.createDataFrame([], f"key {database.schema['key'].dataType.simpleString()}, classification int, vector array<float>").toArrow().schema  # all may be null, as in what tasks return
    key_type = {"s": schema.field("key").type}
    q_kind, s_kind = (df.schema["key"].dataType.simpleString() for df in (queries, database))
    listed = f"array<struct<db_key:{s_kind},db_class:int,distance:float>>"
    kinds = {"cell": "int", "part": "int", "kind": "int", "key": q_kind, "classification": "int", "vector": "array<float>", "home": "int", "last": "float", "found": listed, "cost": "long", "block": "binary"}
    rows = lambda df, kind, **own: df.select(*[(own[c] if c in own else F.lit(kind) if c == "kind" else F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
    blocks = _blocks(database, sent, schema)
    objects = rows(blocks, OBJECT)
    first = rows(_dealt(queries, sent), QUERY, home=F.col("cell"))

    def lists(asked: _Asked) -> pa.Array:
        i, rank = np.nonzero(asked.at >= 0)
        upto = np.concatenate([[0], np.cumsum(np.bincount(i, minlength=len(asked.at)))]).astype(np.int32)
        at = pa.array(asked.at[i, rank])
        keys, classes = (asked.cell.keys.take(at), asked.cell.classes.take(at)) if asked.cell else (pa.nulls(0, key_type["s"]), pa.nulls(0, pa.int32()))
        return pa.ListArray.from_arrays(pa.array(upto), pa.StructArray.from_arrays([keys, classes, pa.array(asked.d[i, rank])], names=["db_key", "db_class", "distance"]))

    columns = ["cell", "part", "kind", "key", "classification", "vector", "home", "last", "found", "cost"]

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = loads(sent.value)
        for cell, q in _met(batches, k, metric, schema):
            column = lambda c, q=q: q.column(c).combine_chunks()
            vectors, home, part = matrix(column("vector")), column("home").to_numpy(), column("part").to_numpy()
            asked = _Asked(cell, vectors, np.full(len(q), np.inf), k, epsilon)
            i32 = lambda x: pa.array(np.asarray(x), pa.int32())
            n, last = len(q), asked.last(np.arange(len(q)))
            out = [column("cell"), column("part"), i32(np.full(n, LIST)), column("key"), column("classification"), pa.nulls(n, pa.list_(pa.float32())), pa.nulls(n, pa.int32()), pa.nulls(n, pa.float32()), lists(asked), pa.array(asked.cost + len(known.voronoi.pivots))]
            yield from pa.Table.from_arrays(out, names=columns).combine_chunks().to_batches(10_000)
            for at in range(0, n, 2_000):
                some = slice(at, at + 2_000)
                i, c, to = known.of(vectors[some], home[some], last[some])
                i = i + at
                other = (c != home[i]) | (to != part[i])
                i, c, to = i[other], c[other], to[other]
                for lo in range(0, len(i), 10_000):
                    x = i[lo : lo + 10_000]
                    pick = lambda name, x=x: column(name).take(pa.array(x))
                    out = [i32(c[lo : lo + 10_000]), i32(to[lo : lo + 10_000]), i32(np.full(len(x), QUERY)), pick("key"), pick("classification"), pick("vector"), pick("home"), pa.array(last[x]), pa.nulls(len(x), pa.list_(out_type)), pa.array(np.zeros(len(x), np.int64))]
                    yield pa.RecordBatch.from_arrays(out, names=columns)

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, q in _met(batches, k, metric, schema):
            column = lambda c, q=q: q.column(c).combine_chunks()
            if q.column("kind")[0].as_py() == LIST:
                found, cost = column("found"), column("cost")
            else:
                asked = _Asked(cell, matrix(column("vector")), column("last").to_numpy(), k, epsilon)
                found, cost = lists(asked), pa.array(asked.cost)
            yield from pa.Table.from_arrays([column("key"), column("classification"), found, cost], names=["query_key", "query_class", "found", "cost"]).combine_chunks().to_batches(10_000)

    out_type = pa.struct([("db_key", key_type["s"]), ("db_class", pa.int32()), ("distance", pa.float32())])
    once = rows(blocks.observe(moved, F.sum("n").alias("n")), OBJECT) if moved else objects
    begun = _by_cell(once.unionByName(first)).mapInArrow(start, ", ".join(f"{c} {kinds[c]}" for c in columns))
    found = _by_cell(objects.unionByName(begun.withColumn("block", F.lit(None).cast("binary")))).mapInArrow(end, f"query_key {q_kind}, query_class int, found {listed}, cost long")
    return _in_order(found.observe(computed, F.sum("cost").alias("n")) if computed else found, k)

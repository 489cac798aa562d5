"""The join over shifted space-filling curves."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from simjoin.functions import hilbert, zorder
from simjoin.functions.metric import L2, L2Quantized, Metric
from simjoin.functions.quantiles import at_ranks, rank_error, ranks_of, sketches
from simjoin.operators.topk import best, crowded, key_parts, partitions, plain_search, searched
from simjoin.plans.config import CurveConfig

#: Size of a sketch for each range: ranges are off by about a seventh of their size.
PER_RANGE = 20


def bounds_of(objects: DataFrame) -> tuple[float, float, int]:
    """Smallest value, largest value, dimension."""
    r = objects.agg(F.min(F.array_min("vector").cast("double")), F.max(F.array_max("vector").cast("double")), F.max(F.size("vector"))).first()
    return (r[0] or 0.0, r[1] or 0.0, r[2] or 0)


class Curve(Protocol):
    """An order of the cells of space, as binary values of one width that compare like it."""

    def encode(self, coords: np.ndarray) -> list[bytes]: ...

    def decode(self, values: list[bytes], dim: int) -> np.ndarray: ...


#: The orders that a join may use. Both cut space into the same cells, so ranges and windows are made alike.
CURVES: dict[str, Curve] = {"z": zorder, "hilbert": hilbert}


def place(coords: Column, curve: str = "z") -> Column:
    """The value of whole coordinates on a curve."""
    if curve not in CURVES:
        raise ValueError(f"curve must be one of {tuple(CURVES)}")
    encode = CURVES[curve].encode

    @F.pandas_udf("binary")
    def value(rows: pd.Series) -> pd.Series:
        return pd.Series(encode(np.stack(rows.to_numpy()).astype(np.int64)) if len(rows) else [])

    return value(coords)


def on_curves(objects: DataFrame, shifts: list[list[int]], scale: float, low: float, curve: str = "z", more: Sequence[str] = ()) -> DataFrame:
    """A row for each object and shift: (shift, key, z, coords), and the columns ``more``."""
    copies = F.array(*[F.struct(F.lit(i).alias("shift"), zorder.quantized(F.col("vector"), scale, low, s).alias("coords")) for i, s in enumerate(shifts)])
    rows = objects.select("key", *more, F.inline(copies))
    return rows.select("shift", "key", place(F.col("coords"), curve).alias("z"), "coords", *more)


Sketched = tuple[np.ndarray, np.ndarray]


def boundaries(sketch: Sketched, n: int) -> np.ndarray:
    """The distinct places that cut a curve into n ranges of equal numbers of objects; fewer where many are at one place."""
    values, upto = sketch
    if not len(values) or n < 2:
        return np.empty(0, object)
    return np.unique(at_ranks(values, upto, upto[-1] * np.arange(1, n) / n))


def ranges(q: Sketched, s: Sketched, n: int, margin: float, dim: int) -> list[tuple[bytes, bytes, bytes, bytes]]:
    """(start, end) of n disjoint query ranges, and of the database ranges that go on for ``margin`` objects at either end."""
    cuts = [bytes(z) for z in boundaries(q, n)]
    ends = [z for z in cuts if z < zorder.greatest(dim)] + [zorder.greatest(dim)]
    starts = [zorder.least(dim), *[(int.from_bytes(z, "big") + 1).to_bytes(len(z), "big") for z in ends[:-1]]]
    values, upto = s
    if not len(values):
        return [(a, b, zorder.least(dim), zorder.greatest(dim)) for a, b in zip(starts, ends, strict=True)]
    first, last = (ranks_of(values, upto, np.array([*edges, None], object)[:-1]) for edges in (starts, ends))
    low = [z if inside else zorder.least(dim) for z, inside in zip(at_ranks(values, upto, first - margin), first - margin >= 1, strict=True)]
    high = [z if inside else zorder.greatest(dim) for z, inside in zip(at_ranks(values, upto, last + margin), last + margin < upto[-1], strict=True)]
    return list(zip(starts, ends, low, high, strict=True))


def range_frame(spark: SparkSession, found: dict[int, list[tuple[bytes, bytes, bytes, bytes]]]) -> DataFrame:
    """(shift, part, q_start, q_end, s_start, s_end) of the ranges of each shift."""
    edges = [(shift, part, *map(bytearray, r)) for shift, rs in sorted(found.items()) for part, r in enumerate(rs)]
    return spark.createDataFrame(edges, "shift int, part int, q_start binary, q_end binary, s_start binary, s_end binary")


def ranges_for(objects: int, config: CurveConfig) -> int:
    """How many ranges a curve of so many objects is cut into."""
    return max(config.partitions, -(-objects // config.range_objects))


def sketched_ranges(q: DataFrame, s: DataFrame, k: int, config: CurveConfig, dim: int) -> dict[int, list[tuple[bytes, bytes, bytes, bytes]]]:
    """The ranges of each shift, from sketches of both sides.

    A range of the database goes on by k objects at either end, and by as many more as the
    sketch may err.
    """
    n = ranges_for(s.where("shift = 0").count(), config)
    size = PER_RANGE * n
    qs, ss = (sketches(df, "shift", "z", size, config.seed) for df in (q, s))
    none = (np.empty(0, object), np.empty(0, np.int64))
    out = {}
    for shift in range(config.shifts):
        own = ss.get(shift, none)
        total = own[1][-1] if len(own[1]) else 0
        out[shift] = ranges(qs.get(shift, none), own, n, k + math.ceil(rank_error(size) * total), dim)
    return out


def partitioned(q: DataFrame, s: DataFrame, found: dict[int, list[tuple[bytes, bytes, bytes, bytes]]]) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``part`` of their shift; database rows may be in several."""
    table = F.broadcast(range_frame(q.sparkSession, found))  # shifts x partitions rows, by the configuration
    on = lambda df, side: df.join(table, (df["shift"] == table["shift"]) & df["z"].between(table[f"{side}_start"], table[f"{side}_end"])).select(df["*"], table["part"])
    return on(q, "q"), on(s, "s")


def cuts(s: DataFrame, config: CurveConfig) -> dict[int, list[bytes]]:
    """Where each curve is cut, from a sketch: into ``partitions`` ranges or more, of about ``range_objects`` objects."""
    size = {r[0]: r[1] for r in s.groupBy("shift").count().collect()}
    n = ranges_for(max(size.values(), default=0), config)
    if n <= 1:
        return {shift: [] for shift in size}
    return {shift: [bytes(z) for z in boundaries(found, n)] for shift, found in sketches(s, "shift", "z", PER_RANGE * n, config.seed).items()}


def _ranged(line: DataFrame, found: dict[int, list[bytes]]) -> DataFrame:
    """The rows with the range of their curve that they are in: the number of cuts at or below them."""
    sent = line.sparkSession.sparkContext.broadcast({shift: np.array(z) for shift, z in found.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shift, z = batch.column("shift").to_numpy(), np.array(batch.column("z").to_pylist(), dtype=bytes)
            out = np.zeros(len(batch), np.int32)
            for x in np.unique(shift):  # values of one curve have one length, so cut-off zeros change no order
                if len(known := sent.value.get(int(x), ())):
                    out[shift == x] = np.searchsorted(known, z[shift == x], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "range"])

    kind = ", ".join(f"{c} {line.schema[c].dataType.simpleString()}" for c in line.columns)
    return line.mapInArrow(run, kind + ", range int")


def _guests(sizes: dict[int, dict[int, int]], ranges: dict[int, int], reach: int) -> list[tuple[int, int, int, int, int]]:
    """(shift, from, to, head, tail): how many objects at either end of a range are guests in another one.

    A range gets the ``reach`` objects before it and after it, from as many ranges as that takes.
    """
    out = []
    for shift, n in ranges.items():
        held = sizes.get(shift, {})
        filled = sorted(held)
        for to in range(n):
            at = bisect_left(filled, to)
            for step, side in ((-1, filled[:at][::-1]), (1, filled[at:])):
                need = reach
                for r in side:
                    if r == to:
                        continue
                    if need <= 0:
                        break
                    take = min(need, held[r])
                    out.append((shift, r, to, take if step > 0 else 0, take if step < 0 else 0))
                    need -= take
    return out


class _Windows:
    """The objects of one range that a window may still need, and the queries that wait for theirs."""

    def __init__(self, reach: int, k: int, metric: Metric):
        self.reach, self.k, self.metric = reach, k, metric
        self.objects: pa.Table | None = None  # the last ones of ``seen``
        self.queries: pa.Table | None = None
        self.vectors, self.places, self.seen = np.empty((0, 0)), np.empty(0, np.int64), 0

    def see(self, rows: pa.RecordBatch, end: bool = False) -> Iterator[pa.RecordBatch]:
        """Rows in the order of the curve; what is found for the queries whose windows are whole."""
        db = rows.column("db").to_numpy() == 1
        both = pa.Table.from_batches([rows])
        fresh, asking = both.filter(pa.array(db)), both.filter(pa.array(~db))
        self.places = np.concatenate([self.places, self.seen + np.cumsum(db)[~db]])
        self.queries = asking if self.queries is None else pa.concat_tables([self.queries, asking])
        self.objects = fresh if self.objects is None else pa.concat_tables([self.objects, fresh]).combine_chunks()
        self.seen += len(fresh)
        yield from self._answer(end)
        self.objects = self.objects.slice(max(0, len(self.objects) - 2 * self.reach))

    def _answer(self, end: bool) -> Iterator[pa.RecordBatch]:
        low = np.maximum(1, self.places - self.reach + 1)
        ready = np.ones(len(low), bool) if end else (self.places + self.reach <= self.seen) & (low + 2 * self.reach - 1 <= self.seen)
        low = np.maximum(1, np.minimum(low, self.seen - 2 * self.reach + 1))[ready] - 1 - (self.seen - len(self.objects))
        q, width = self.queries.filter(pa.array(ready)).combine_chunks(), min(2 * self.reach, self.seen)
        self.queries, self.places = self.queries.filter(pa.array(~ready)), self.places[~ready]
        if not len(q) or not width:
            return
        s, x = (_numbers(t.column("vector").combine_chunks()) for t in (self.objects, q))
        keys = key_parts(self.objects.column("key").combine_chunks())
        for lo in range(0, len(q), 64):
            at = low[lo : lo + 64, None] + np.arange(width)
            d = self.metric.rows(np.repeat(x[lo : lo + 64], width, 0), s[at.ravel()]).reshape(at.shape)
            most = np.partition(d, self.k - 1, axis=1)[:, self.k - 1 : self.k] if width > self.k else np.inf
            i, j = np.nonzero(d <= most)
            d, j = d[i, j], at[i, j]
            order = np.lexsort((*[part[j] for part in reversed(keys)], d, i))
            i, d, j = i[order], d[order], j[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < self.k
            pick = lambda t, c, rows: t.column(c).combine_chunks().take(pa.array(rows))
            i, j = lo + i[keep], j[keep]
            yield pa.RecordBatch.from_arrays([pick(q, "key", i), pick(q, "classification", i), pick(self.objects, "key", j), pick(self.objects, "classification", j), pa.array(d[keep], pa.float32())], names=["query_key", "query_class", "db_key", "db_class", "distance"])


def _numbers(column: pa.Array) -> np.ndarray:
    """Vectors of one length, of the numbers that they have."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def near_on_curve(q: DataFrame, s: DataFrame, reach: int, k: int, config: CurveConfig, metric: Metric) -> DataFrame:
    """(query_key, query_class, db_key, db_class, distance): on each curve, the k nearest of the ``reach`` objects before and after the query.

    A query's place is the number of objects before it; near an end of the curve the window
    moves inward, so 2 x reach objects are met if there are so many. A curve is cut into
    ranges of a bounded number of objects, and a range has the 2 x reach objects on either
    side of it as guests, so that the same objects are met as on the curve as a whole. Rows
    bring their vectors along, so distances are computed where the rows pass in the order of
    the curve: no pair of a query and an object moves but the k nearest. A task holds one
    window and one batch. Only the sizes of ranges come to the driver. Objects of one
    Z-value are in one range.
    """
    spark, at, rest = s.sparkSession, ("shift", "range"), ("z", "key", "classification", "vector")
    found = cuts(s, config)
    objects = _ranged(s.select("shift", *rest), found)
    sizes: dict[int, dict[int, int]] = {}
    for shift, r, n in _ranged(s.select("shift", "z"), found).groupBy(*at).count().collect():
        sizes.setdefault(shift, {})[r] = n
    guests = _guests(sizes, {shift: len(z) + 1 for shift, z in found.items()}, 2 * reach)
    line = objects.select(*at, *rest)
    if guests:
        plan = spark.createDataFrame([(shift, r, to, head, tail, sizes[shift][r]) for shift, r, to, head, tail in guests], "shift int, range int, to int, head int, tail int, size long")
        placed = objects.withColumn("i", F.row_number().over(W.partitionBy(*at).orderBy("z", "key")))
        visiting = placed.join(F.broadcast(plan), list(at)).where("i <= head or i > size - tail").select("shift", F.col("to").alias("range"), *rest)
        line = line.unionByName(visiting)
    line = line.withColumn("db", F.lit(1)).unionByName(_ranged(q.select("shift", *rest), found).select(*at, *rest).withColumn("db", F.lit(0)))
    line = line.repartition(partitions(q), *at).sortWithinPartitions(*at, "z", "db", "key").drop("z")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, windows, last = None, None, None
        for batch in batches:
            shift, part = (batch.column(c).to_numpy() for c in at)
            first = np.flatnonzero(np.concatenate([[True], (np.diff(shift) != 0) | (np.diff(part) != 0)])) if len(batch) else []
            for lo, hi in zip(first, [*first[1:], len(batch)], strict=True):
                if (shift[lo], part[lo]) != now:
                    if windows:
                        yield from windows.see(last.slice(0, 0), end=True)
                    now, windows = (shift[lo], part[lo]), _Windows(reach, k, metric)
                last = batch.slice(lo, hi - lo)
                yield from windows.see(last)
        if windows:
            yield from windows.see(last.slice(0, 0), end=True)

    kinds = [df.schema["key"].dataType.simpleString() for df in (q, s)]
    return line.mapInArrow(run, f"query_key {kinds[0]}, query_class int, db_key {kinds[1]}, db_class int, distance float")


def knn_curve(queries: DataFrame, database: DataFrame, k: int, config: CurveConfig | None = None, shifts: list[list[int]] | None = None, edges: dict[int, list[tuple[bytes, bytes, bytes, bytes]]] | None = None) -> DataFrame:
    """The nearest of the objects that are near on some shifted curve.

    With ``entire_buckets`` all objects of a query's range of the curve are met, else the
    ``reach`` x k before and as many after it. ``edges`` fixes the ranges. With ``only_zorder`` distances are those of the quantized
    coordinates, which are also all that is kept of an object.
    """
    config = config or CurveConfig()
    low, high, dim = bounds_of(queries.select("vector").unionByName(database.select("vector")))
    if config.scale * (high - low) + config.range >= 2**31:
        raise ValueError("scale x spread + range must stay below 2**31")
    shifts = shifts or zorder.shifts(dim, config.shifts, config.range, config.seed)
    if config.entire_buckets and not config.only_zorder:
        whole = {i: [(zorder.least(dim), zorder.greatest(dim)) * 2] for i in range(len(shifts))}
        q, s = (on_curves(df, shifts, config.scale, low, config.curve).drop("coords") for df in (queries, database))
        q, s = partitioned(q, s, edges or (whole if config.partitions <= 1 else sketched_ranges(q, s, k, config, dim)))
        g = F.concat_ws(":", "shift", "part")
        q, s = (a.select("key", g.alias("g")).join(b.select("key", "classification", "vector"), "key") for a, b in ((q, queries), (s, database)))
        return best(searched(q, s, plain_search(k), shares=crowded(q, s)), k)
    metric: Metric = L2()
    sides = [df.select("key", "classification", "vector", F.col("vector").alias("kept")) for df in (queries, database)]
    if config.only_zorder:
        sides, metric = [df.withColumn("kept", zorder.quantized(F.col("vector"), config.scale, low, [0] * dim)) for df in sides], L2Quantized(config.scale)
    q, s = (on_curves(df, shifts, config.scale, low, config.curve, ("classification", "kept")).drop("coords").withColumnRenamed("kept", "vector") for df in sides)
    return best(near_on_curve(q, s, k * config.reach, k, config, metric), k)

"""Top-k of neighbour candidates, and the search of co-located queries and objects."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from simjoin.functions.metric import L2, Metric, near_pairs

COLUMNS = ["query_key", "query_class", "rank", "db_key", "distance", "db_class"]
#: Queries of one group that are held together; larger groups are dealt to several tasks.
QUERIES = 20_000
#: Objects of one group that one task sees; larger groups are dealt to several as well.
OBJECTS = 2_000_000
#: Crowded groups whose list is broadcast; a longer list is joined by its key.
FEW = 100_000


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def best(candidates: DataFrame, k: int, repeated: bool = True) -> DataFrame:
    """The k nearest candidates of each query in the order (distance, db_key), with ranks.

    ``repeated``: an object may be there several times for a query, and counts once. The
    plan has a group limit before the shuffle, so each task sends k rows per query at most.
    """
    if repeated:
        candidates = candidates.groupBy("query_key", "query_class", "db_key", "db_class").agg(F.min("distance").alias("distance"))
    order = W.partitionBy("query_key").orderBy("distance", "db_key")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*COLUMNS)


def pair_type(queries: DataFrame, database: DataFrame) -> str:
    q, s = queries.schema["key"].dataType.simpleString(), database.schema["key"].dataType.simpleString()
    return f"query_key {q}, query_class int, db_key {s}, db_class int, distance float, cost long"


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a float32 matrix."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(sizes), int(sizes[0]) if len(sizes) else 0)


def crowded(queries: DataFrame, database: DataFrame | None = None, most: int = QUERIES, objects: int = OBJECTS) -> DataFrame | None:
    """(g, ways, parts) of the groups with more queries or objects than one task should take, or None."""
    sides = queries.select("g", F.lit(1).alias("q"), F.lit(0).alias("s"))
    if database is not None:
        sides = sides.unionByName(database.select("g", F.lit(0).alias("q"), F.lit(1).alias("s")))
    share = lambda c, n: F.greatest(F.lit(1), F.ceil(F.sum(c) / n)).cast("int")
    found = sides.groupBy("g").agg(share("q", most).alias("ways"), share("s", objects).alias("parts")).where("ways > 1 or parts > 1")
    n = found.count()
    return None if not n else F.broadcast(found) if n <= FEW else found


def key_parts(keys: pa.Array) -> list[np.ndarray]:
    """Arrays whose order, the first one first, is that of the keys."""
    if pa.types.is_struct(keys.type):
        return [x for child in keys.flatten() for x in key_parts(child)]
    return [keys.to_numpy(zero_copy_only=False)]


class Nearest:
    """The k nearest objects so far of each of n queries, in the order (distance, key).

    Of the objects only keys and classes are held, of about as many as are in the lists.
    """

    def __init__(self, n: int, k: int):
        self.k, self.d, self.at = k, np.full((n, k), np.inf, np.float32), np.full((n, k), -1)
        self.held: list[pa.Table] = []  # of accepted objects; ``at`` counts through all of them
        self.parts: list[np.ndarray] = []
        self.size = 0

    @property
    def last(self) -> np.ndarray:
        """The k-th distances; infinite where fewer are held."""
        return self.d[:, -1]

    def add(self, i: np.ndarray, d: np.ndarray, j: np.ndarray, objects: pa.RecordBatch) -> None:
        """Objects ``j`` of a batch (key, classification) as candidates of the queries ``i``."""
        near = d <= self.last[i]
        i, d, j = i[near], d[near], j[near]
        if not len(i):
            return
        new, j = np.unique(j, return_inverse=True)
        rows = pa.Table.from_batches([objects.select(["key", "classification"])]).take(pa.array(new))
        self.held.append(rows)
        fresh = key_parts(rows.column("key").combine_chunks())
        self.parts = [np.concatenate(x) for x in zip(self.parts, fresh, strict=True)] if self.parts else fresh
        who, i = np.unique(i, return_inverse=True)
        old_i, old_rank = np.nonzero(self.at[who] >= 0)
        all_i, all_d, all_at = np.concatenate([old_i, i]), np.concatenate([self.d[who][old_i, old_rank], d]), np.concatenate([self.at[who][old_i, old_rank], j + self.size])
        order = np.lexsort((*[x[all_at] for x in reversed(self.parts)], all_d, all_i))
        all_i, all_d, all_at = all_i[order], all_d[order], all_at[order]
        rank = np.arange(len(all_i)) - np.searchsorted(all_i, all_i)
        keep = rank < self.k
        self.d[who[all_i[keep]], rank[keep]], self.at[who[all_i[keep]], rank[keep]] = all_d[keep], all_at[keep]
        self.size += len(new)
        if self.size > 4 * self.at.size + 10_000:
            self._forget()

    def _forget(self) -> None:
        """Drops the objects that no list holds any more."""
        live, at = np.unique(self.at[self.at >= 0], return_inverse=True)
        self.held, self.parts, self.size = [pa.concat_tables(self.held).take(pa.array(live))], [x[live] for x in self.parts], len(live)
        self.at[self.at >= 0] = at

    def lists(self, q: pa.Table, cost: int) -> Iterator[pa.RecordBatch]:
        """The candidates of the queries ``q``; ``cost``, distances that were computed, stands in the first row."""
        i, rank = np.nonzero(self.at >= 0)
        if not len(i):
            return
        pick = lambda t, name, rows: t.column(name).combine_chunks().take(pa.array(rows))
        held, first = pa.concat_tables(self.held), np.zeros(len(i), np.int64)
        first[0] = cost
        columns = [pick(q, "key", i), pick(q, "classification", i), pick(held, "key", self.at[i, rank]), pick(held, "classification", self.at[i, rank]), pa.array(self.d[i, rank]), pa.array(first)]
        yield from pa.Table.from_arrays(columns, names=["query_key", "query_class", "db_key", "db_class", "distance", "cost"]).combine_chunks().to_batches(10_000)


class Scan(Protocol):
    """The queries of one group while its objects pass by, batch for batch."""

    nearest: Nearest
    cost: int

    def see(self, objects: pa.RecordBatch) -> None: ...


Search = Callable[[pa.Table], Scan]


def searched(queries: DataFrame, database: DataFrame, search: Search, extra: Sequence[str] = (), order: Sequence[str] = (), shares: DataFrame | None = None) -> DataFrame:
    """Candidates from each group of rows with one ``g``, found by a ``search`` that its objects stream past.

    Both sides have g (string), key, classification, vector and the ``extra`` columns, the
    database also those of ``order``. Spark sorts the rows of a group, queries first, then
    objects by ``order``, so a task holds the queries of one group, their nearest objects so
    far and one batch of objects. ``shares`` (g, ways, parts) deals the queries of a group
    to so many tasks and its objects to so many for each of those; groups that it does not
    name are one task's. A query has at most k candidates of each task.
    """
    kind = dict(database.dtypes)
    side = lambda df, db: df.select("g", F.lit(db).alias("db"), "key", "classification", "vector", *extra, *[F.col(c) if db else F.lit(None).cast(kind[c]).alias(c) for c in order if c not in extra])
    rows = [side(queries, 0), side(database, 1)]
    if shares is None:
        rows = [r.withColumns({"way": F.lit(0), "part": F.lit(0)}) for r in rows]
    else:
        rows = [r.join(shares, "g", "left") for r in rows]
        ways, parts = F.coalesce("ways", F.lit(1)), F.coalesce("parts", F.lit(1))
        to_one = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
        to_all = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        rows[0] = rows[0].withColumn("way", to_one(ways)).withColumn("part", to_all(parts))
        rows[1] = rows[1].withColumn("part", to_one(parts)).withColumn("way", to_all(ways))
        rows = [r.drop("ways", "parts") for r in rows]
    both = rows[0].unionByName(rows[1]).repartition(partitions(queries), "g", "way", "part").sortWithinPartitions("g", "way", "part", "db", *order, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, q, scan = None, [], None

        def lists() -> Iterator[pa.RecordBatch]:
            if scan is not None:
                yield from scan.nearest.lists(q, scan.cost)

        for batch in batches:
            g = np.array(batch.column("g").to_pylist(), dtype=object)
            way, part, db = (batch.column(c).to_numpy() for c in ("way", "part", "db"))
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (way[1:] != way[:-1]) | (part[1:] != part[:-1]) | (db[1:] != db[:-1])
            starts = np.flatnonzero(new)
            for lo, hi in zip(starts, np.append(starts[1:], len(g)), strict=True):
                rows, name = batch.slice(lo, hi - lo), (g[lo], way[lo], part[lo])
                if name != now:
                    yield from lists()
                    now, q, scan = name, [], None
                if db[lo] == 0:
                    q.append(rows)
                elif q:  # objects of a group without queries pass unread
                    if scan is None:
                        q = pa.Table.from_batches(q).combine_chunks()
                        scan = search(q)
                    scan.see(rows)
        yield from lists()

    return both.mapInArrow(run, pair_type(queries, database))


class _Plain:
    def __init__(self, q: pa.Table, k: int, metric: Metric):
        self.metric, self.vectors = metric, matrix(q.column("vector").combine_chunks())
        self.nearest, self.cost = Nearest(len(self.vectors), k), 0

    def see(self, objects: pa.RecordBatch) -> None:
        s = matrix(objects.column("vector"))
        if self.vectors.shape[1] != s.shape[1]:
            raise ValueError("queries and objects differ in dimension")
        self.cost += len(self.vectors) * len(s)
        for i, j, d in near_pairs(self.metric, self.vectors, s, self.nearest.last, self.nearest.k):
            self.nearest.add(i, d, j, objects)


def plain_search(k: int, metric: Metric | None = None) -> Search:
    """All queries against all objects of a group."""
    return lambda q: _Plain(q, k, metric or L2())

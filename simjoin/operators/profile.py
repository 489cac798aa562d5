"""What a vector table is like: ranges, distances, duplicates; and its projection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simjoin.functions.metric import L2, Metric
from simjoin.operators.topk import matrix, partitions

BINS = 500


def min_max(features: DataFrame) -> DataFrame:
    """(min_value, max_value) over all bins, and over the defaults of sparse records."""
    if "vector" in features.columns:
        return features.agg(F.min(F.array_min("vector")).alias("min_value"), F.max(F.array_max("vector")).alias("max_value"))
    return features.agg(F.min(F.least(F.array_min("bin_values"), "other")).alias("min_value"), F.max(F.greatest(F.array_max("bin_values"), "other")).alias("max_value"))


def sub_dimensions(features: DataFrame, dim: int) -> DataFrame:
    """Sparse records cut to their first ``dim`` bins; the last one is always named."""
    kept = F.filter(F.arrays_zip("bin_keys", "bin_values"), lambda b: b["bin_keys"] < dim)
    rows = features.withColumn("_kept", kept)
    ends = F.coalesce(F.array_max("_kept.bin_keys"), F.lit(-1)) == dim - 1
    keys, values = F.col("_kept.bin_keys"), F.col("_kept.bin_values")
    cut = {"bin_keys": F.when(ends, keys).otherwise(F.array_append(keys, F.lit(dim - 1))), "bin_values": F.when(ends, values).otherwise(F.array_append(values, F.col("other")))}
    return rows.select(*[cut[c].alias(c) if c in cut else F.col(f"`{c}`") for c in features.columns])


def vector_text(line: str = "value"):
    """What stands behind the second semicolon of a record's line."""
    second = F.expr(f"locate(';', `{line}`, locate(';', `{line}`) + 1)")
    return F.substring(F.col(line), second + 1, F.length(line))


def duplicate_vectors(queries: DataFrame, database: DataFrame, vector: str = "vector", min_count: int = 1) -> DataFrame:
    """(db_count, query_count, vector) of vectors that both sides have, the most frequent first.

    Both sides are counted before they meet, so copies cost one row each in the join.
    """
    count = lambda df, name: df.groupBy(F.col(vector).alias("vector")).agg(F.count("*").alias(name))
    found = count(database, "db_count").where(F.col("db_count") >= min_count).join(count(queries, "query_count"), "vector")
    return found.select("db_count", "query_count", "vector").orderBy(F.desc("db_count"), "vector")


def sampled(objects: DataFrame, fraction: float, seed: int = 937) -> DataFrame:
    """The objects whose key's hash falls into the fraction."""
    if fraction >= 1:
        return objects
    return objects.where(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30)) < int(fraction * (1 << 30)))


def distances(objects: DataFrame, metric: Metric | None = None, block: int = 4_096) -> DataFrame:
    """(distance) of each pair of different objects, once; meant for a sample."""
    return _of_pairs(objects, lambda d: pa.RecordBatch.from_arrays([pa.array(d.exact(), pa.float32())], names=["distance"]), "distance float", metric, block)


class _Pairs:
    """The distances of pairs (i, j) of rows of x and y: ``rough``, each off by less than ``off``, and exact where asked for.

    For L2 the rough ones come from a matrix product; those of rows that are almost alike,
    of which the product says little, are exact.
    """

    def __init__(self, metric: Metric, x: np.ndarray, y: np.ndarray, i: np.ndarray | None, j: np.ndarray | None):
        self.metric, self.x, self.y, self.i, self.j = metric, x, y, i, j
        if not isinstance(metric, L2):
            self.rough, self.off = self.exact().astype(np.float64), 0.0
            return
        x64, y64 = x.astype(np.float64), y.astype(np.float64)
        own, other = (np.einsum("ij,ij->i", v, v) for v in (x64, y64))
        d2, norm = x64 @ y64.T, float(own.max() + other.max())
        d2 *= -2
        d2 += own[:, None]
        d2 += other
        d2 = d2.ravel() if i is None else d2[i, j]
        alike = np.flatnonzero(d2 < 1e-6 * norm)
        self.rough = np.sqrt(np.maximum(d2, 0, out=d2), out=d2)
        self.rough[alike] = self.exact(alike)
        self.off = 1.2e-7 * float(self.rough.max(initial=0)) + 1e-9 * norm**0.5  # a float32 root, and the product's rounding

    def exact(self, at: np.ndarray | None = None) -> np.ndarray:
        if at is None:
            d = self.metric.all_pairs(self.x, self.y)
            return d.ravel() if self.i is None else d[self.i, self.j]
        i, j = divmod(at, len(self.y)) if self.i is None else (self.i[at], self.j[at])
        step = 1 << 14
        return np.concatenate([np.empty(0, np.float32), *[self.metric.rows(self.x[i[lo : lo + step]], self.y[j[lo : lo + step]]) for lo in range(0, len(at), step)]])


def _of_pairs(objects: DataFrame, made: Callable[[_Pairs], pa.RecordBatch], kind: str, metric: Metric | None = None, block: int | None = None) -> DataFrame:
    """What ``made`` makes of the distances of all pairs, a bounded number at a time.

    Objects are dealt to blocks by a hash of the key, and each pair of blocks meets in one
    group, whose distances a kernel computes. An object moves once for each block, so blocks
    are as large as memory allows, unless that leaves too few groups.
    """
    own, total = metric or L2(), objects.count()
    n = max(1, -(-total // (block or min(16_384, max(1_024, total // 16)))))
    rows = objects.select("key", "vector", F.pmod(F.xxhash64("key"), F.lit(n)).alias("b"))
    other = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("o")
    copies = rows.select("key", "vector", "b", other).select(F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "key", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts).combine_chunks()
            v, side = matrix(t.column("vector").combine_chunks()), t.column("b").to_numpy() == t.column("i").to_numpy()
            same = t.column("i")[0] == t.column("j")[0]
            x, y = (v, v) if same else (v[side], v[~side])
            if not len(x) or not len(y):
                return
            step = max(1, (1 << 18) // len(y))
            for at in range(0, len(x), step):
                some, rest, below = x[at : at + step], y, (None, None)
                if same:
                    rest = y[: at + len(some)]
                    below = np.nonzero(np.arange(at, at + len(some))[:, None] > np.arange(len(rest))[None])
                if below[0] is None or len(below[0]):
                    yield made(_Pairs(own, some, rest, *below))

        now, parts = None, []
        for batch in batches:
            i, j = batch.column("i").to_numpy(), batch.column("j").to_numpy()
            first = np.flatnonzero(np.diff(i, prepend=-1) | np.diff(j, prepend=-1)) if len(batch) else []
            for lo, hi in zip(first, [*first[1:], len(batch)], strict=True):
                if (i[lo], j[lo]) != now and parts:
                    yield from out(parts)
                    parts = []
                now = (i[lo], j[lo])
                parts.append(batch.slice(lo, hi - lo))
        if parts:
            yield from out(parts)

    return copies.repartition(partitions(objects), "i", "j").sortWithinPartitions("i", "j").mapInArrow(run, kind)


def distance_histogram(objects: DataFrame, fraction: float, bins: int = BINS, metric: Metric | None = None) -> DataFrame:
    """(step, count): the pairs of a sample, of a share of the objects that has to be named, by the nearest of ``bins`` steps from the smallest distance.

    The first pass finds the range, the second counts, each where the distances are
    computed: a task returns a few numbers per block and no pairs. Of two steps at one
    distance the upper one is taken. Steps without a pair are absent.
    """
    some = sampled(objects, fraction)

    def extremes(d: _Pairs) -> pa.RecordBatch:
        low, high = d.exact(np.flatnonzero(d.rough <= d.rough.min() + 2 * d.off)).min(), d.exact(np.flatnonzero(d.rough >= d.rough.max() - 2 * d.off)).max()
        return pa.RecordBatch.from_arrays([pa.array([low], pa.float32()), pa.array([high], pa.float32())], names=["low", "high"])

    ends = _of_pairs(some, extremes, "low float, high float", metric)
    low, high = ends.agg(F.min("low"), F.max("high")).first()
    if low is None:
        return ends.select(F.col("low").alias("step"), F.lit(0).cast("long").alias("count")).limit(0)
    low, width = float(low), (float(high) - float(low)) / bins

    def counted(d: _Pairs) -> pa.RecordBatch:
        at = np.zeros(len(d.rough), np.int64)
        if width:
            place = (d.rough - low) / width + 0.5
            at = place.astype(np.int64)
            place -= at
            edge = np.flatnonzero((place <= 2 * d.off / width) | (place >= 1 - 2 * d.off / width))  # steps that the rough distance may miss
            at[edge] = np.floor((d.exact(edge).astype(np.float64) - low) / width + 0.5).astype(np.int64)
            at = np.minimum(bins - 1, at)
        n = np.bincount(at, minlength=bins)
        held = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(held), pa.array(n[held])], names=["bin", "n"])

    counts = _of_pairs(some, counted, "bin long, n long", metric).groupBy("bin").agg(F.sum("n").alias("count"))
    return counts.select((F.lit(low) + F.col("bin") * width).cast("float").alias("step"), "count").orderBy("step")

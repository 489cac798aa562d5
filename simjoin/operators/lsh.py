"""The join over hash tables: objects of a query's buckets, nearest first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simjoin.functions import hashing
from simjoin.functions.hashing import Tables
from simjoin.functions.metric import Metric
from simjoin.operators.topk import best, crowded, matrix, plain_search, searched
from simjoin.plans.config import LshConfig


def dimension_stats(objects: DataFrame) -> DataFrame:
    """(dim, mean, std, n): mean and population deviation of each dimension."""
    return objects.select(F.posexplode("vector").alias("dim", "v")).groupBy("dim").agg(F.avg(F.col("v").cast("double")).alias("mean"), F.stddev_pop(F.col("v").cast("double")).alias("std"), F.count("*").alias("n"))


def tables_for(database: DataFrame, config: LshConfig) -> Tables:
    """Hash tables fitted to the database: one row per dimension comes to the driver."""
    stats = dimension_stats(database).orderBy("dim").collect()
    mean, std = np.array([r.mean for r in stats]), np.array([r.std for r in stats])
    std = np.where(std > 1e-9 * np.abs(mean), std, 0)  # what is left of a constant is rounding
    pool = hashing.generated(len(stats), config.tables * max(1, config.multiplier), config.functions, config.w, mean, std, config.seed)
    if config.multiplier <= 1:
        return pool
    half = database.where(F.pmod(F.xxhash64("key", F.lit(config.seed)), F.lit(2)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # counts, sums and squares of each function's raw value, one row per task and function
        total = np.zeros((3, pool.b.size))
        for batch in batches:
            raw = pool.scores(matrix(batch.column(0))) @ pool.a.reshape(pool.b.size, -1).T
            total += np.stack([np.full(pool.b.size, len(raw)), raw.sum(0), (raw**2).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(pool.b.size)), *map(pa.array, total)], names=["f", "n", "s", "q"])

    sums = half.select("vector").mapInArrow(run, "f long, n double, s double, q double").groupBy("f").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("f").collect()
    spread = np.array([r.q / r.n - (r.s / r.n) ** 2 if r.n else 0 for r in sums]) if sums else np.zeros(pool.b.size)
    return hashing.widest(pool, spread, config.tables, config.functions)


def bucketed(objects: DataFrame, tables: Tables) -> DataFrame:
    """A row for each object and table: (g, key, classification, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = tables.signatures(matrix(batch.column("vector"))) if len(batch) else ()
            names = [[f"{t}:{','.join(map(str, s))}" for t, s in enumerate(row)] for row in sig.tolist()] if len(batch) else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.list_(pa.string()))], names=[*batch.schema.names, "names"])

    kind = ", ".join(f"{c} {objects.schema[c].dataType.simpleString()}" for c in ("key", "classification", "vector"))
    return objects.select("key", "classification", "vector").mapInArrow(run, kind + ", names array<string>").select(F.explode("names").alias("g"), "key", "classification", "vector")


def knn_lsh(queries: DataFrame, database: DataFrame, k: int, config: LshConfig | None = None, tables: Tables | None = None, metric: Metric | None = None) -> DataFrame:
    """The nearest objects that share a bucket with the query in some table, k at most.

    A bucket's objects stream past its queries and leave k each, and both sides of a large
    bucket are dealt to several tasks, so it makes work but no large intermediate result. Queries without a neighbour have no row.
    """
    tables = tables or tables_for(database, config or LshConfig())
    q, s = bucketed(queries, tables), bucketed(database, tables)
    return best(searched(q, s, plain_search(k, metric), shares=crowded(q, s)), k)

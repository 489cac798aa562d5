"""How near an approximate neighbour list is to an exact one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simjoin.sources.results import nested

MEASURES = ("distance_diff", "precision", "distance_ratio", "effective_error", "avg_effective_error")
# Neighbours at distances closer than one float32 ulp of 1 count as the same,
# and a base list may be worse than its approximation by this much at most.
SAME, TOLERANCE = 2.0**-23, 1e-4
RELATIONS = ("le", "ge", "eq")


def set_relations(base: DataFrame, compare: DataFrame, relation: str) -> DataFrame:
    """(query_key, missing_in): queries that break the relation between the two query sets.

    ``le``: each base query is compared; ``ge``: each compared query has a base; ``eq``: both.
    """
    if relation not in RELATIONS:
        raise ValueError(f"relation must be one of {RELATIONS}")
    b, c = base.select("query_key").distinct(), compare.select("query_key").distinct()
    out = b.limit(0).withColumn("missing_in", F.lit(""))
    if relation in ("le", "eq"):
        out = out.unionByName(b.join(c, "query_key", "left_anti").withColumn("missing_in", F.lit("compare")))
    if relation in ("ge", "eq"):
        out = out.unionByName(c.join(b, "query_key", "left_anti").withColumn("missing_in", F.lit("base")))
    return out


def _matches(bk: list, bd: np.ndarray, ck: list, cd: np.ndarray) -> np.ndarray:
    """For each k, neighbours in common among the first k of both lists, which are in order of distance.

    One walk finds the pairs, as those of shorter lists are the ones whose ranks both reach.
    """
    common, j = np.zeros(len(bd), np.int64), 0
    for i, (key, d) in enumerate(zip(bk, bd.tolist(), strict=False)):
        same = lambda j: ck[j] == key or abs(cd[j] - d) < SAME  # noqa: B023, E731
        while j < len(cd) and cd[j] <= d and not same(j):
            j += 1
        if j < len(cd) and same(j):
            common[max(i, j)] += 1
            j += 1
    return np.cumsum(common)


def measures(base: DataFrame, compare: DataFrame) -> DataFrame:
    """(query_key, k, and the five measures) for each query of both and each k both reach."""
    b = nested(base).select("query_key", F.col("neighbours.db_key").alias("bk"), F.col("neighbours.distance").alias("bd"))
    c = nested(compare).select("query_key", F.col("neighbours.db_key").alias("ck"), F.col("neighbours.distance").alias("cd"))
    both = b.join(c, "query_key").select("query_key", "bk", "bd", "ck", "cd")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for row, (bk, bd, ck, cd) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                most = min(len(bd), len(cd))
                bd, cd = np.array(bd[:most], np.float64), np.array(cd[:most], np.float64)
                sums = np.cumsum(bd), np.cumsum(cd)
                if (bd - TOLERANCE > cd).any() or (sums[0] - TOLERANCE * np.arange(1, most + 1) > sums[1]).any():
                    raise ValueError("a base list is worse than the list it is compared with")
                error = np.where(bd == 0, cd + 1, cd / np.where(bd == 0, 1, bd))
                ratio = np.where(sums[1] == 0, 1, sums[0] / np.where(sums[1] == 0, 1, sums[1]))
                mean = np.cumsum(error) / np.arange(1, most + 1)
                ranks = np.arange(1, most + 1)
                at += [row] * most
                rows += zip(ranks.tolist(), cd - bd, _matches(bk[:most], bd, ck, cd) / ranks, ratio, error, mean, strict=True)
            values = [pa.array([r[i] for r in rows], pa.int32() if i == 0 else pa.float64()) for i in range(6)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *values], names=["query_key", "k", *MEASURES])

    key = base.schema["query_key"].dataType.simpleString()
    return both.mapInArrow(run, f"query_key {key}, k int, " + ", ".join(f"{m} double" for m in MEASURES))


def precision_eval(base: DataFrame, compare: DataFrame, relation: str | None = None) -> DataFrame:
    """k and the minimum, maximum and average of each measure: 16 columns.

    Averages are over all queries of the larger list, so a query that is missing from one
    counts as zero. With ``relation`` the query sets are checked first.
    """
    if relation and (bad := set_relations(base, compare, relation).limit(1).collect()):
        raise ValueError(f"query {bad[0].query_key} is missing in {bad[0].missing_in}")
    total = max(base.select("query_key").distinct().count(), compare.select("query_key").distinct().count(), 1)
    sums = [f(m) for m in MEASURES for f in (lambda m: F.min(m).alias(f"{m}_min"), lambda m: F.max(m).alias(f"{m}_max"), lambda m: (F.sum(m) / total).alias(f"{m}_avg"))]
    return measures(base, compare).groupBy("k").agg(*sums).orderBy("k")


def kth_distance_stats(results: DataFrame, k: int) -> DataFrame:
    """(avg_dist, max_dist) of the k-th neighbours, or of a bounds method's bounds."""
    if "upper_bound" in results.columns:
        return results.agg(F.avg("upper_bound").alias("avg_dist"), F.max("upper_bound").alias("max_dist"))
    return results.where(F.col("rank") == k).agg(F.avg(F.col("distance").cast("double")).alias("avg_dist"), F.max("distance").cast("double").alias("max_dist"))


def histogram(values: DataFrame, column: str, bins: int = 500) -> DataFrame:
    """(bin, start, count) of fixed-width bins from the minimum on; the maximum has its own."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    if low is None:
        return values.select(F.lit(0).alias("bin"), F.lit(0.0).alias("start"), F.lit(0).cast("long").alias("count")).limit(0)
    step = (float(high) - float(low)) / bins
    b = F.floor((F.col(column).cast("double") - float(low)) / step).cast("int") if step else F.lit(0)
    return values.where(F.col(column).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("count")).select("bin", (F.lit(float(low)) + F.col("bin") * step).alias("start"), "count")

"""A sweep over the parameters of the pivot join."""

from __future__ import annotations

import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from itertools import product

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame

from simjoin.operators.evaluate import kth_distance_stats
from simjoin.operators.pivot_index import PivotIndex
from simjoin.operators.pivot_join import PivotJoin
from simjoin.plans.config import METHODS, PivotConfig
from simjoin.sources.shared import discard, shared_folder

SCHEMA = "stat string, value double, method string, k int, max_rec_depth int, filter_ratio double, pivot_count int, reducers int, seconds double"


@dataclass(frozen=True)
class SweepConfig:
    pivot_counts: tuple[int, ...]
    k_values: tuple[int, ...]
    reducers: tuple[int, ...]
    depths: tuple[int, ...]
    filter_ratios: tuple[float, ...]
    methods: tuple[str, ...] = METHODS

    @staticmethod
    def of(pivot_counts: str, k_values: str, reducers: str, depths: str, filter_ratios: str, methods: str = ";".join(METHODS)) -> SweepConfig:
        """From lists that are separated by semicolons."""
        ints = lambda s: tuple(int(x) for x in s.split(";") if x.strip())
        return SweepConfig(ints(pivot_counts), ints(k_values), ints(reducers), ints(depths), tuple(float(x) for x in filter_ratios.split(";") if x.strip()), tuple(m.strip().upper() for m in methods.split(";") if m.strip()))


def sweep(queries: DataFrame, database: DataFrame, config: SweepConfig, base: PivotConfig | None = None, together: int = 1) -> DataFrame:
    """Two rows, AVG and MAX of the k-th distance, for each combination; of its upper bound for the *_BOUNDS methods.

    For each number of pivots the database is assigned once, at the greatest depth and for
    the greatest k, and kept as an index that all combinations share. EXACT and
    EXACT_BOUNDS do not depend on depth and ratio, so they run once for the others. So many
    combinations as ``together`` says run at a time, each in a scheduler pool of its own;
    their times are then those of a shared cluster. Where a combination fails, so does the sweep.
    """
    base, spark, rows = base or PivotConfig(), queries.sparkSession, []
    for pivots in config.pivot_counts:
        path = f"{shared_folder(spark)}/sweep-{uuid.uuid4().hex}"
        index = PivotIndex.create(database, path, max(config.k_values), pivots, base.static_count, max(config.depths), seed=base.seed)
        grid = list(product(config.k_values, config.reducers, config.methods, config.depths, config.filter_ratios))
        one = lambda c: c if c[2] not in ("EXACT", "EXACT_BOUNDS") else (*c[:3], config.depths[0], config.filter_ratios[0])
        runs = list(dict.fromkeys(map(one, grid)))

        def run(c: tuple, pivots=pivots, index=index) -> tuple[float, float, float]:
            k, groups, method, depth, ratio = c
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"sweep-{method}")
            return _measured(queries, index, k, replace(base, pivot_count=pivots, groups=groups, method=method, max_rec_depth=depth, filter_ratio=ratio))

        try:
            with ThreadPoolExecutor(together) as pool:
                found = dict(zip(runs, pool.map(inheritable_thread_target(spark)(run), runs), strict=True))
        finally:
            discard(spark, path)
        for c in grid:
            k, groups, method, depth, ratio = c
            avg, most, seconds = found[one(c)]
            rows += [(stat, value, method, k, depth, ratio, pivots, groups, seconds) for stat, value in (("AVG", avg), ("MAX", most))]
    return spark.createDataFrame(rows, SCHEMA)


def _measured(queries: DataFrame, database: PivotIndex, k: int, config: PivotConfig) -> tuple[float, float, float]:
    began = time.monotonic()
    r = kth_distance_stats(PivotJoin(queries, database, k, config).result(), k).first()
    return r.avg_dist, r.max_dist, time.monotonic() - began


def append_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("sep", ";").csv(path)

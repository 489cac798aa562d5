"""A pivot index that outlives a join.

A folder keeps the pivots, the objects with their distances to them, and the statistics of
their cells, in versions. New objects become a version of their own: they alone are read,
assigned and summed up. Statistics of versions merge, because all of them are sums, least
and greatest values, so a join over an index makes those of the queries only.

    pivots/            pivot, vector, static, depth, k
    objects/version=n  key, classification, vector, nearest_pivots, nearest_dists, static_dists
    cells/version=n    statistics per cell; written last, so a version without them does not count

One writer at a time; readers may go on, as versions never change.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simjoin.functions.metric import L2, Metric
from simjoin.operators.pivots import Voronoi, assigned, cell_stats, sampled_pivots, static_pivots

CELLS = "pivot_id int, is_database boolean, min_dist float, max_dist float, n long, size long, smallest array<float>, static_low array<float>, static_high array<float>"


@dataclass(frozen=True)
class PivotIndex:
    """``depth``: nearest pivots that are kept of each object; ``k``: neighbours that a join may ask for, at most."""

    spark: SparkSession
    path: str
    pivots: np.ndarray
    static: np.ndarray
    depth: int
    k: int
    metric: Metric

    @staticmethod
    def create(database: DataFrame, path: str, k: int, pivot_count: int = 1000, static_count: int = 10, depth: int = 1, pivots: np.ndarray | None = None, metric: Metric | None = None, seed: int = 937) -> PivotIndex:
        """An index of ``database`` (key, classification, vector) in a new folder, as its version 0."""
        spark, metric = database.sparkSession, metric or L2()
        chosen = sampled_pivots(database, pivot_count, seed) if pivots is None else np.asarray(pivots, np.float32)
        if not len(chosen):
            raise ValueError("the database is empty")
        static, depth = static_pivots(chosen, static_count, metric), min(depth, len(chosen))
        rows = [(p, v.tolist(), p in set(static.tolist()), depth, k) for p, v in enumerate(chosen)]
        spark.createDataFrame(rows, "pivot int, vector array<float>, static boolean, depth int, k int").coalesce(1).write.parquet(f"{path}/pivots")
        index = PivotIndex(spark, path, chosen, static, depth, k, metric)
        index._write(database, 0)
        return index

    @staticmethod
    def open(spark: SparkSession, path: str, metric: Metric | None = None) -> PivotIndex:
        rows = spark.read.parquet(f"{path}/pivots").orderBy("pivot").collect()
        return PivotIndex(spark, path, np.array([r.vector for r in rows], np.float32), np.array([r.pivot for r in rows if r.static], np.int64), rows[0].depth, rows[0].k, metric or L2())

    def _write(self, objects: DataFrame, version: int) -> None:
        own = f"{self.path}/objects/version={version}"
        # what a writer that failed has left is no version
        assigned(objects, self.pivots, self.static, self.depth, self.metric).write.mode("overwrite").parquet(own)
        stored = self.spark.read.parquet(own).withColumn("is_database", F.lit(True))
        cell_stats(stored, self.k, len(self.static)).coalesce(1).write.parquet(f"{self.path}/cells/version={version}")

    def _cells(self) -> DataFrame:
        return self.spark.read.schema(f"{CELLS}, version int").parquet(f"{self.path}/cells")

    @property
    def versions(self) -> list[int]:
        return sorted(r.version for r in self._cells().select("version").distinct().collect())

    def append(self, objects: DataFrame) -> int:
        """Adds objects whose keys are new, as a version; returns its number."""
        version = max(self.versions) + 1
        self._write(objects, version)
        return version

    def objects(self, depth: int = 1, versions: list[int] | None = None) -> DataFrame:
        """The assigned objects with their ``depth`` nearest pivots."""
        if depth > self.depth:
            raise ValueError(f"the index keeps {self.depth} nearest pivots")
        rows = self.spark.read.parquet(f"{self.path}/objects").where(F.col("version").isin(self.versions if versions is None else versions))
        return rows.withColumns({c: F.slice(c, 1, depth) for c in ("nearest_pivots", "nearest_dists")}).drop("version")

    def cells(self) -> DataFrame:
        """The statistics of all versions as one; a row per version and cell is read."""
        smallest = F.slice(F.array_sort(F.flatten(F.collect_list("smallest"))), 1, self.k).alias("smallest")
        each = lambda f, c: F.array(*[f(F.get(c, F.lit(i))) for i in range(len(self.static))]).cast("array<float>").alias(c)
        return self._cells().groupBy("pivot_id", "is_database").agg(F.min("min_dist").alias("min_dist"), F.max("max_dist").alias("max_dist"), F.sum("n").alias("n"), F.sum("size").alias("size"), smallest, each(F.min, "static_low"), each(F.max, "static_high"))

    def voronoi(self, queries: DataFrame, k: int) -> Voronoi:
        """What a join has to know, with statistics of assigned ``queries``; objects are not read."""
        if k > self.k:
            raise ValueError(f"the index is made for {self.k} neighbours")
        own = cell_stats(queries.withColumn("is_database", F.lit(False)), k, len(self.static))
        cells = self.cells().withColumn("smallest", F.slice("smallest", 1, k))
        return Voronoi.of(self.pivots, cells.unionByName(own), k, self.metric)

"""K-means and bag-of-words histograms of the clusters of an object's vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simjoin.functions.metric import PAIRS


@dataclass(frozen=True)
class Clusters:
    centroids: np.ndarray
    cost: float  # within-set sum of squared errors
    model: KMeansModel


def train(rows: DataFrame, k: int, iterations: int = 20, seed: int = 937, partitions: int | None = None) -> Clusters:
    """k-means|| on the ``vector`` column (array of numbers), dealt anew to ``partitions`` if given."""
    data = rows.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    data = (data.repartition(partitions) if partitions else data).persist()
    try:
        model = KMeans(k=k, maxIter=iterations, seed=seed).fit(data)
        return Clusters(np.array(model.clusterCenters()), model.summary.trainingCost, model)
    finally:
        data.unpersist()


def assign_centroid(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The rows with ``cluster``, the nearest centroid (the first of equally near ones)."""
    return _nearest(rows, centroids).withColumn("cluster", F.col("_near.cluster")).drop("_near")


def cost(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cost, n): the sum of the squared distances to the nearest centroids, and how many vectors."""
    return _nearest(rows, centroids).agg(F.sum("_near.d").alias("cost"), F.count("_near").alias("n"))


def _nearest(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The rows with ``_near``: the nearest centroid and the squared distance. The matrix, a parameter's size, is broadcast."""
    sent = rows.sparkSession.sparkContext.broadcast(np.asarray(centroids, np.float64))

    @F.pandas_udf("cluster int, d double")
    def near(vectors: pd.Series) -> pd.DataFrame:
        c, v = sent.value, np.array(vectors.tolist(), np.float64).reshape(len(vectors), -1)
        step, at, d = max(1, PAIRS // max(1, c.size)), [], []
        for i in range(0, len(v), step):
            x = v[i : i + step, None, :] - c[None]
            x = np.einsum("ijk,ijk->ij", x, x)
            at.append(x.argmin(1))
            d.append(x.min(1))
        empty = np.empty(0)
        return pd.DataFrame({"cluster": np.concatenate([*at, empty]).astype(np.int32), "d": np.concatenate([*d, empty])})

    return rows.withColumn("_near", near(F.col("vector").cast("array<double>")))


def bow_histogram(assigned: DataFrame, k: int) -> DataFrame:
    """(id, histogram): how many of an object's vectors fall into each of k clusters, as floats."""
    counts = assigned.groupBy("id", "cluster").agg(F.count("*").cast("float").alias("n"))
    of = F.map_from_entries(F.collect_list(F.struct("cluster", "n"))).alias("of")  # k entries at most
    each = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.try_element_at(F.col("of"), i), F.lit(0.0).cast("float")))
    return counts.groupBy("id").agg(of).select("id", each.alias("histogram"))


def histogram_lines(histograms: DataFrame) -> DataFrame:
    """``id;h0;h1;...``"""
    return histograms.select(F.concat_ws(";", F.col("id").cast("string"), F.array_join(F.transform("histogram", lambda h: h.cast("string")), ";")).alias("value"))


def bag_of_words(rows: DataFrame, k: int, path: str, iterations: int = 20, seed: int = 937, extended: bool = False, partitions: int | None = None) -> Clusters:
    """Trains, assigns and writes: histograms; with ``extended`` also objects_centroids and centroids."""
    found = train(rows, k, iterations, seed, partitions)
    assigned = assign_centroid(rows, found.centroids)
    if not extended:
        histogram_lines(bow_histogram(assigned, k)).write.mode("overwrite").text(path)
        return found
    name = F.concat(F.col("id").cast("string"), F.coalesce("coords", F.lit("")))
    assigned.select(F.concat_ws(";", name, F.col("cluster").cast("string")).alias("value")).write.mode("overwrite").text(f"{path}/objects_centroids")
    histogram_lines(bow_histogram(assigned, k)).write.mode("overwrite").text(f"{path}/histograms")
    lines = [(";".join(map(str, c)),) for c in found.centroids.tolist()]
    rows.sparkSession.createDataFrame(lines, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/centroids")
    return found

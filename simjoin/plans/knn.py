"""One entry point for the joins."""

from __future__ import annotations

from pyspark.sql import DataFrame

from simjoin.operators.curve import knn_curve
from simjoin.operators.lsh import knn_lsh
from simjoin.operators.naive import knn_naive
from simjoin.operators.pivot_join import knn_pivot
from simjoin.operators.sparse import knn_sparse

JOINS = {"naive": knn_naive, "pivot": knn_pivot, "curve": knn_curve, "lsh": knn_lsh, "sparse": knn_sparse}


def knn_join(queries: DataFrame, database: DataFrame, k: int, method: str = "naive", config=None, **options) -> DataFrame:
    """The k nearest objects of ``database`` for each query, in the long form.

    Both sides have key, classification and vector (``simjoin.sources.features.dense`` makes
    them of sparse records, which the method ``sparse`` takes as they are); query keys are unique. ``config`` is the method's configuration.
    """
    if method not in JOINS:
        raise ValueError(f"method must be one of {tuple(JOINS)}")
    if config is not None:
        options["config"] = config
    return JOINS[method](queries, database, k, **options)

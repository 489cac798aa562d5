"""Queries that arrive as a stream, joined with a static database."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from simjoin.plans.knn import knn_join


def knn_stream(queries: DataFrame, database: DataFrame, k: int, path: str, **options) -> DataStreamWriter:
    """A writer that joins each micro-batch and writes it below ``path``, a folder per batch.

    A batch that is run again after a failure replaces its folder, so results are exactly once.
    """
    return queries.writeStream.foreachBatch(lambda rows, n: knn_join(rows, database, k, **options).write.mode("overwrite").parquet(f"{path}/batch={n}"))

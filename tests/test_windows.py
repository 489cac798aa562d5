"""The window search along curves moves no pairs."""

import numpy as np

from simjoin.operators.curve import knn_curve
from simjoin.plans.config import CurveConfig
from simjoin.plans.metrics import measured
from tests.test_joins import brute, data, frame, lists


def test_windows_move_rows_not_pairs(spark):
    """300 queries of 200 objects on each of three curves would be 180,000 pairs; a task passes a window on, batch for batch."""
    q, s = data(71, 300, 8), data(72, 600, 8)
    config = CurveConfig(shifts=3, range=1000, scale=1000.0, entire_buckets=False, partitions=2, reach=20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    try:
        with measured(spark) as cost:
            got = lists(knn_curve(frame(spark, q), frame(spark, s), 5, config))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute(q, s, 5)
    assert np.mean([len(set(got[i]) & set(want[i])) / 5 for i in want]) > 0.6
    assert cost.values["shuffleWriteBytes"] < 750_000

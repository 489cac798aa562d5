"""Quantiles of values that can only be compared, from sketches that merge.

A sketch (Karnin, Lang, Liberty 2016) keeps values in levels; one of level h stands for 2**h
values. A level that is full is sorted and every second value moves up, from a random first
one. A sketch of size s has ranks right to within about 3 / s of all values, whatever their
distribution, and sketches of parts merge to a sketch of the whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How much smaller each level is than the one above it.
SHRINK = 2 / 3


def rank_error(size: int) -> float:
    """By which share of all values a rank may be wrong."""
    return 3 / size


class Sketch:
    def __init__(self, size: int, seed: int = 0):
        self.size, self.levels, self.rng = size, [[]], np.random.default_rng(seed)

    def _room(self, level: int) -> int:
        return max(8, int(self.size * SHRINK ** (len(self.levels) - 1 - level)))

    def add(self, values: list, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].extend(values)
        h = 0
        while h < len(self.levels):
            if len(self.levels[h]) > self._room(h):
                if h + 1 == len(self.levels):
                    self.levels.append([])
                held = sorted(self.levels[h])
                odd = [held.pop()] if len(held) % 2 else []  # so that weights add up to the number of values
                self.levels[h] = odd
                self.levels[h + 1].extend(held[int(self.rng.integers(2)) :: 2])
            h += 1

    def weighted(self) -> tuple[np.ndarray, np.ndarray]:
        """The values in order, and how many there are up to each."""
        rows = sorted((v, 1 << h) for h, level in enumerate(self.levels) for v in level)
        values = np.empty(len(rows), object)
        values[:] = [v for v, _ in rows]
        return values, np.cumsum([w for _, w in rows], dtype=np.int64)


def sketches(df: DataFrame, by: str, value: str, size: int, seed: int = 0) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each value of ``by``, a small integer, the weighted values of a sketch of the binary column ``value``.

    A task sketches its rows; sketches are merged by as many tasks as there are shuffle
    partitions, then by one, which streams them and holds one sketch for each ``by``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Sketch] = {}
        for batch in batches:
            keys, levels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for key, level in np.unique(np.stack([keys, levels]), axis=1).T.tolist():
                rows = np.flatnonzero((keys == key) & (levels == level))
                held.setdefault(key, Sketch(size, seed)).add(batch.column(2).take(pa.array(rows)).to_pylist(), level)
        for key, sketch in held.items():
            for level, values in enumerate(sketch.levels):
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(values), pa.int32()), pa.array([level] * len(values), pa.int32()), pa.array(values, pa.binary())], names=["by", "level", "value"])

    merged = df.select(F.col(by).cast("int").alias("by"), F.lit(0).alias("level"), F.col(value).alias("value"))
    for tasks in (None, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1):
        merged = (merged.repartition(tasks) if tasks else merged).mapInArrow(run, "by int, level int, value binary")
    out: dict[int, Sketch] = {}
    for row in merged.collect():  # one sketch for each ``by``
        sketch = out.setdefault(row["by"], Sketch(1 << 30))
        sketch.add([bytes(row["value"])], row["level"])
    return {key: sketch.weighted() for key, sketch in out.items()}


def at_ranks(values: np.ndarray, upto: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The values of given ranks, counted from 1."""
    return values[np.minimum(np.searchsorted(upto, ranks), len(values) - 1)]


def ranks_of(values: np.ndarray, upto: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """How many values lie before each of ``wanted``."""
    return np.concatenate([[0], upto])[np.searchsorted(values, wanted)]

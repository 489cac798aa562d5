"""p-stable hashing of z-scored vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tables:
    """Hash functions floor((a . z + b) / w) in tables; z is the z-scored vector."""

    a: np.ndarray  # tables x functions x dimensions
    b: np.ndarray  # tables x functions
    w: float
    mean: np.ndarray
    std: np.ndarray  # a dimension without spread adds nothing

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        spread = self.std > 0
        return np.where(spread, (vectors.astype(np.float64) - self.mean) / np.where(spread, self.std, 1), 0)

    def signatures(self, vectors: np.ndarray) -> np.ndarray:
        """rows x tables x functions."""
        t, m, dim = self.a.shape
        raw = self.scores(vectors) @ self.a.reshape(t * m, dim).T
        return np.floor((raw.reshape(len(vectors), t, m) + self.b) / self.w).astype(np.int64)

    def column(self, vector: Column, table: int) -> Column:
        """A table's signature as an array of whole numbers, in SQL functions."""
        number = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
        spread = np.where(self.std > 0, self.std, 1)
        terms = lambda a: F.zip_with(F.zip_with(vector, number(self.mean), lambda v, mu: v.cast("double") - mu), number(np.where(self.std > 0, a / spread, 0)), lambda x, f: x * f)
        one = lambda a, b: F.floor((F.aggregate(terms(a), F.lit(0.0), lambda acc, x: acc + x) + F.lit(float(b))) / F.lit(float(self.w)))
        return F.array(*[one(a, b) for a, b in zip(self.a[table], self.b[table], strict=True)])


def frame(spark: SparkSession, tables: Tables) -> DataFrame:
    """(table_id, function_id, a, b, w): the hash functions, for a look at them."""
    rows = [(t, f, tables.a[t, f].tolist(), float(tables.b[t, f]), float(tables.w)) for t in range(tables.b.shape[0]) for f in range(tables.b.shape[1])]
    return spark.createDataFrame(rows, "table_id int, function_id int, a array<double>, b double, w double")


def generated(dim: int, tables: int, functions: int, w: float, mean: np.ndarray, std: np.ndarray, seed: int) -> Tables:
    rng = np.random.default_rng(seed)
    a, b = rng.standard_normal((tables, functions, dim)), rng.uniform(0, w, (tables, functions))
    return Tables(a, b, w, mean, std)


def widest(pool: Tables, spread: np.ndarray, tables: int, functions: int) -> Tables:
    """Of a pool (tables x functions) the functions of the largest spread, dealt in order."""
    order = np.argsort(-spread.ravel(), kind="stable")[: tables * functions]
    a, b = pool.a.reshape(-1, pool.a.shape[2])[order], pool.b.ravel()[order]
    return Tables(a.reshape(tables, functions, -1), b.reshape(tables, functions), pool.w, pool.mean, pool.std)

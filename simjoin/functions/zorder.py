"""Z-values: interleaved bits of integer coordinates, as fixed-width big-endian BINARY.

In each bit plane, from the highest, dimension 0 comes first. Spark compares BINARY byte by
byte without sign, so the order of values is that of the curve at any dimension.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 32


def encode(coords: np.ndarray) -> list[bytes]:
    """Z-values of rows of non-negative coordinates below 2**32."""
    n, dim = coords.shape
    bits = np.unpackbits(np.ascontiguousarray(coords.astype(">u4")).view(np.uint8).reshape(n, dim, 4), axis=2)
    return [r.tobytes() for r in np.packbits(bits.transpose(0, 2, 1).reshape(n, BITS * dim), axis=1)]


def decode(z: list[bytes], dim: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(b"".join(z), np.uint8).reshape(len(z), -1), axis=1)
    planes = bits[:, : BITS * dim].reshape(len(z), BITS, dim).transpose(0, 2, 1)
    return np.packbits(planes, axis=2).reshape(len(z), dim, 4).copy().view(">u4").reshape(len(z), dim).astype(np.int64)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def coordinates(z: pd.Series) -> pd.Series:
    return pd.Series([decode([v], len(v) // 4)[0].astype(np.int32) for v in z])


def zstring(coords: Column) -> Column:
    """The Z-value as a string of 0 and 1, in SQL functions alone."""
    planes = F.transform(F.sequence(F.lit(BITS - 1), F.lit(0)), lambda b: F.array_join(F.transform(coords, lambda c: F.call_function("shiftright", c, b).bitwiseAND(F.lit(1)).cast("string")), ""))
    return F.array_join(planes, "")


def least(dim: int) -> bytes:
    return b"\x00" * (4 * dim)


def greatest(dim: int) -> bytes:
    return b"\xff" * (4 * dim)


def shifts(dim: int, count: int, reach: int, seed: int) -> list[list[int]]:
    """Shift vectors of whole numbers below ``reach``; the first is zero."""
    rng = np.random.default_rng(seed)
    return [[0] * dim, *(rng.integers(0, max(1, reach), dim).tolist() for _ in range(count - 1))][:count]


def quantized(vector: Column, scale: float, low: float, shift: list[int]) -> Column:
    """Whole coordinates: what lies above ``low``, scaled, cut, and shifted."""
    moved = F.array(*[F.lit(int(s)) for s in shift])
    return F.zip_with(vector, moved, lambda v, s: ((v.cast("double") - F.lit(float(low))) * F.lit(float(scale))).cast("int") + s)

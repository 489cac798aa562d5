"""Distances: as column expressions, and as kernels over blocks of vectors.

A distance is the float32 root of a float64 sum of squares of float32 differences, so that
both forms give the same bits up to the order of the sum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Distances that are held at a time while a block is searched.
PAIRS = 1 << 20


class Metric(Protocol):
    """What a join needs of a distance. Pruning by pivots needs the triangle inequality."""

    def column(self, x: Column, y: Column) -> Column: ...

    def rows(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances of rows of x to the rows of y beside them."""
        ...

    def all_pairs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray: ...


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def _squares(x: Column, y: Column) -> Column:
    def one(a: Column, b: Column) -> Column:
        d = (a.cast("float") - b.cast("float")).cast("double")
        return d * d

    return F.zip_with(x, y, one)


def beside(metric: Metric) -> Callable[..., Column]:
    """A column function of two vectors, by the metric's kernel over batches; for long vectors it is
    several times as fast as ``column``, whose loops over elements are not compiled."""

    @F.pandas_udf("float")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="float32")
        return pd.Series(metric.rows(np.stack(x.to_numpy()), np.stack(y.to_numpy())).astype(np.float32))

    return distance


class L2:
    """Euclidean distance of dense vectors of one length."""

    #: Any four points can be laid out in a space of three dimensions with their distances, see ``bounds.beyond_plane``.
    four_point = True

    def column(self, x: Column, y: Column) -> Column:
        same = F.size(x) == F.size(y)
        return F.when(same, F.sqrt(_sum(_squares(x, y))).cast("float")).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("float"))

    def rows(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        d = (x.astype(np.float32) - y.astype(np.float32)).astype(np.float64)
        return np.sqrt(np.einsum("ij,ij->i", d, d)).astype(np.float32)

    def all_pairs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out, step = np.empty((len(x), len(y)), np.float32), max(1, PAIRS // max(1, y.size))
        for i in range(0, len(x), step):
            d = (x[i : i + step, None, :].astype(np.float32) - y[None].astype(np.float32)).astype(np.float64)
            out[i : i + step] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
        return out


class L2Quantized:
    """Euclidean distance of integer coordinates that were multiplied by ``scale``."""

    def __init__(self, scale: float):
        self.scale = scale

    def column(self, x: Column, y: Column) -> Column:
        def one(a: Column, b: Column) -> Column:
            d = (a - b).cast("double") / F.lit(float(self.scale))
            return d * d

        return F.sqrt(_sum(F.zip_with(x, y, one))).cast("float")

    def rows(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        d = (x.astype(np.int64) - y.astype(np.int64)) / float(self.scale)
        return np.sqrt(np.einsum("ij,ij->i", d, d)).astype(np.float32)

    def all_pairs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.stack([self.rows(np.broadcast_to(v, y.shape), y) for v in x]) if len(x) else np.empty((0, len(y)), np.float32)


def l2_sparse(x: Column, y: Column) -> Column:
    """L2 of two sparse records (structs of other, bin_keys, bin_values) without densifying.

    Bins that neither names differ by the difference of the defaults; there are as many as
    the dimension, the last named bin of either plus one, has beyond the union of bins.
    Where a default is not zero, both must end in the same bin.
    """
    value = lambda r, b: F.coalesce(F.try_element_at(F.map_from_arrays(r["bin_keys"], r["bin_values"]), b), r["other"])
    named = lambda r, b: F.array_contains(r["bin_keys"], b)

    def one(b: Column) -> Column:
        close = (value(x, b) - value(y, b)).cast("double")
        wide = value(x, b).cast("double") - value(y, b).cast("double")
        d = F.when(named(x, b) & named(y, b), close).otherwise(wide)
        return d * d

    bins = F.array_union(x["bin_keys"], y["bin_keys"])
    ends = [F.coalesce(F.array_max(r["bin_keys"]), F.lit(-1)) for r in (x, y)]
    rest = (F.greatest(*ends) + 1 - F.size(bins)).cast("double") * F.pow(x["other"].cast("double") - y["other"].cast("double"), F.lit(2.0))
    fits = ((x["other"] == 0) & (y["other"] == 0)) | (ends[0] == ends[1])
    total = F.sqrt(_sum(F.transform(bins, one)) + rest).cast("float")
    return F.when(fits, total).otherwise(F.raise_error(F.lit("records differ in dimension")).cast("float"))


def _beside(metric: Metric, x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of the rows i of x to the rows j of y, of which a bounded number is laid out at a time."""
    step = max(1, PAIRS // max(1, x.shape[1]))
    return np.concatenate([np.empty(0, np.float32), *[metric.rows(x[i[at : at + step]], y[j[at : at + step]]) for at in range(0, len(i), step)]])


class _Products:
    """Squares of L2 distances to the rows of s, less the queries' own squares, by a matrix product.

    All are moved by the mean of s, so that squares are not much larger than distances, and
    multiplied as float32 where its range allows that.
    """

    def __init__(self, s: np.ndarray):
        self.centre = s.mean(0, dtype=np.float64)
        self.s64 = s - self.centre
        self.norm = np.einsum("ij,ij->i", self.s64, self.s64)
        self.most = float(self.norm.max())
        self.of_kind: dict[type, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(the squares, how much is left out of each row, how far those of a row may be off)."""
        q64 = q - self.centre
        own = np.einsum("ij,ij->i", q64, q64)
        kind = np.float32 if self.most + own.max() < 1e30 and self.most + own.min() > 1e-25 else np.float64
        if kind not in self.of_kind:
            self.of_kind[kind] = (-2 * self.s64.T).astype(kind), self.norm.astype(kind)
        s, norm = self.of_kind[kind]
        d2 = q64.astype(kind) @ s
        d2 += norm
        # a product of n numbers is off by n roundings of |x||y| at most; the rest is of sums, of what was moved, and of the definition's differences
        return d2, own, (q.shape[1] + 24) * 2.0**-23 * (own + self.most) if kind is np.float32 else 1e-9 * (own + self.most)


def near_pairs(metric: Metric, q: np.ndarray, s: np.ndarray, limit: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of q, row of s, distance), in blocks of q: of each row its k nearest, and others no nearer than those may be
    among them, but none beyond the row's ``limit``.

    For L2 a matrix product finds candidates, and only their distances are computed by the
    definition; a margin covers the product's rounding. What is held is bounded, however
    many rows q has and however few s.
    """
    if not len(s):
        return
    products = _Products(s) if isinstance(metric, L2) else None
    step = max(1, PAIRS // len(s))
    for at in range(0, len(q), step):
        part, most = q[at : at + step], limit[at : at + step].astype(np.float64)
        if products:
            d, own, off = products.of(part)
            width = lambda last, rows: (last + np.abs(last) * 1e-6 + 2 * off[rows] - own[rows])[:, None]  # noqa: B023, E731
            last = most**2
        else:
            d, own = metric.all_pairs(part, s), np.zeros(len(part))
            width = lambda last, rows: last[:, None]
            last = most
        if k == 1:
            last = np.minimum(last, d.min(1).astype(np.float64) + own)
        near = d <= width(last, slice(None)).astype(d.dtype)
        many = np.flatnonzero(np.count_nonzero(near, axis=1) > 4 * k) if len(s) > k > 1 else ()
        if len(many):  # where the limit leaves few, they need not be told apart
            some = d[many]
            kth = np.partition(some, k - 1, axis=1)[:, k - 1].astype(np.float64)
            near[many] = some <= width(np.minimum(last[many], kth + own[many]), many).astype(d.dtype)
        i, j = np.divmod(np.flatnonzero(near), len(s))
        found = _beside(metric, part, i, s, j) if products else d[i, j]
        inside = found <= most[i]
        yield i[inside] + at, j[inside], found[inside]


def block_topk(metric: Metric, q: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of s, distance) of the k nearest rows of s, by distance, then row."""
    empty = np.empty(0, np.int64)
    found = [(empty, empty, np.empty(0, np.float32)), *near_pairs(metric, q, s, np.full(len(q), np.inf), k)]
    i, j, d = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep], d[keep]

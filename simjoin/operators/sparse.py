"""The exact join of sparse records, as they are.

A record names some of its bins; the others have its default. With x = default + rest, the
square of a distance is

    D (a - b)^2 + 2 (a - b) (sum of x's rest - sum of y's) + |x's rest|^2 + |y's rest|^2 - 2 rest . rest

so all that pairs need of each other is the product of their rests, which are zero in bins
that are not named. An inverted list over the bins of a block gives it: per bin, the records
that name it. Nothing is as long as the dimension.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simjoin.functions.metric import PAIRS
from simjoin.operators.naive import BLOCK, joined_by_blocks
from simjoin.operators.topk import Nearest, Search

#: Above any bin.
_WIDTH = 1 << 32
#: Blocks whose shared bins are named this often, on average, are multiplied as matrices, so many bins at a time.
FILLED, BINS = 0.1, 512


@dataclass(frozen=True)
class Block:
    """Records as compressed rows: those of row i are bins[start[i] : start[i + 1]], ascending."""

    other: np.ndarray
    start: np.ndarray
    bins: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(records: pa.StructArray) -> Block:
        keys, values = records.field("bin_keys"), records.field("bin_values")
        sizes = keys.value_lengths().to_numpy(zero_copy_only=False)
        if (sizes != values.value_lengths().to_numpy(zero_copy_only=False)).any():
            raise ValueError("a record has not one value for each bin")
        out = Block(records.field("other").to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), keys.flatten().to_numpy(zero_copy_only=False).astype(np.int64), values.flatten().to_numpy(zero_copy_only=False).astype(np.float32))
        if (np.diff(out.places) <= 0).any():
            raise ValueError("bins are not in ascending order")
        return out

    def __len__(self) -> int:
        return len(self.other)

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.start)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.sizes)

    @property
    def places(self) -> np.ndarray:
        """One ascending number for each named bin of each row."""
        return self.rows * _WIDTH + self.bins

    @property
    def dims(self) -> np.ndarray:
        """The last named bin plus one."""
        last = self.bins[np.maximum(self.start[1:] - 1, 0)] if len(self.bins) else np.zeros(len(self), np.int64)
        return np.where(self.sizes > 0, last + 1, 0)

    @property
    def rests(self) -> np.ndarray:
        return self.values.astype(np.float64) - self.other.astype(np.float64)[self.rows]

    def part(self, lo: int, hi: int) -> Block:
        a, b = self.start[lo], self.start[min(hi, len(self))]
        return Block(self.other[lo:hi], self.start[lo : hi + 1] - a, self.bins[a:b], self.values[a:b])


def _by_bin(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The inverted list: bins, where the records of each begin, records, rests."""
    order = np.argsort(block.bins, kind="stable")
    bins, first = np.unique(block.bins[order], return_index=True)
    return bins, np.append(first, len(order)), block.rows[order], block.rests[order]


def _dense(n: int, first: np.ndarray, rows: np.ndarray, rests: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The rests of ``n`` records in the given bins of an inverted list."""
    out, sizes = np.zeros((n, len(bins))), np.diff(first)[bins]
    column = np.repeat(np.arange(len(bins)), sizes)
    at = first[bins][column] + np.arange(len(column)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[rows[at], column] = rests[at]
    return out


def products(q: Block, s: Block) -> np.ndarray:
    """The products of the rests of all rows of q and s."""
    out = np.zeros((len(q), len(s)))
    (q_bins, q_first, q_rows, q_rests), (s_bins, s_first, s_rows, s_rests) = _by_bin(q), _by_bin(s)
    _, a, b = np.intersect1d(q_bins, s_bins, assume_unique=True, return_indices=True)
    named = np.diff(q_first)[a] / max(1, len(q)) * np.diff(s_first)[b] / max(1, len(s))  # of all products of a bin, those that are there
    full = named >= FILLED**2
    for at in range(0, int(full.sum()), BINS):
        out += _dense(len(q), q_first, q_rows, q_rests, a[full][at : at + BINS]) @ _dense(len(s), s_first, s_rows, s_rests, b[full][at : at + BINS]).T
    a, b = a[~full], b[~full]
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        left, right = slice(q_first[i], q_first[i + 1]), slice(s_first[j], s_first[j + 1])
        out[np.ix_(q_rows[left], s_rows[right])] += np.outer(q_rests[left], s_rests[right])
    return out


def _entries(block: Block, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the named bins of the given rows, one row after the other: whose they are (by position in ``rows``), and where they stand."""
    sizes = block.sizes[rows]
    whose = np.repeat(np.arange(len(rows)), sizes)
    return whose, block.start[rows][whose] + np.arange(len(whose)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def distances(q: Block, s: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The distances of rows i of q and rows j of s beside them, by the definition of ``metric.l2_sparse``."""

    def found(block: Block, rows: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        places, wanted = block.places, rows * _WIDTH + bins
        at = np.minimum(np.searchsorted(places, wanted), max(0, len(places) - 1))
        return (places[at] == wanted, at) if len(places) else (np.zeros(len(wanted), bool), at)

    total, a, b = np.zeros(len(i)), q.other.astype(np.float64)[i], s.other.astype(np.float64)[j]
    whose, at = _entries(q, i)
    both, there = found(s, j[whose], q.bins[at])
    d = q.values[at].astype(np.float64) - b[whose]
    d[both] = (q.values[at][both] - s.values[there[both]]).astype(np.float64)
    total += np.bincount(whose, d * d, len(i))
    named = q.sizes[i].astype(np.int64)
    whose, at = _entries(s, j)
    alone = ~found(q, i[whose], s.bins[at])[0]
    d = a[whose[alone]] - s.values[at[alone]].astype(np.float64)
    total += np.bincount(whose[alone], d * d, len(i))
    named += np.bincount(whose[alone], minlength=len(i))
    return np.sqrt(total + (np.maximum(q.dims[i], s.dims[j]) - named) * (a - b) ** 2).astype(np.float32)


def near_records(q: Block, s: Block, limit: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As ``metric.near_pairs``: candidates by products, their distances by definition."""
    if not len(s):
        return
    s_rows, s_rests, s_other = s.rows, s.rests, s.other.astype(np.float64)
    s_sum, s_norm = (np.bincount(s_rows, x, len(s)) for x in (s_rests, s_rests**2))
    step = max(1, PAIRS // len(s))
    for at in range(0, len(q), step):
        part = q.part(at, at + step)
        other, rows, rests, most = part.other.astype(np.float64), part.rows, part.rests, limit[at : at + step].astype(np.float64)
        if (((other != 0)[:, None] | (s_other != 0)) & (part.dims[:, None] != s.dims)).any():
            raise ValueError("records differ in dimension")
        own_sum, own_norm = (np.bincount(rows, x, len(part)) for x in (rests, rests**2))
        apart, dims = other[:, None] - s_other, np.maximum(part.dims[:, None], s.dims)
        d2 = dims * apart**2 + 2 * apart * (own_sum[:, None] - s_sum) + own_norm[:, None] + s_norm - 2 * products(part, s)
        scale = own_norm + s_norm.max() + (dims * apart**2).max(1) + np.abs(2 * apart * (np.abs(own_sum)[:, None] + np.abs(s_sum))).max(1)
        last = most**2
        if len(s) > k:
            last = np.minimum(last, np.partition(d2, k - 1, axis=1)[:, k - 1])
        i, j = np.nonzero(d2 <= (last + np.abs(last) * 1e-6 + 1e-9 * scale)[:, None])
        d = distances(part, s, i, j)
        inside = d <= most[i]
        yield i[inside] + at, j[inside], d[inside]


class _Records:
    def __init__(self, q: pa.Table, k: int):
        self.records = Block.of(q.column("vector").combine_chunks())
        self.nearest, self.cost = Nearest(len(self.records), k), 0

    def see(self, objects: pa.RecordBatch) -> None:
        s = Block.of(objects.column("vector"))
        self.cost += len(self.records) * len(s)
        for i, j, d in near_records(self.records, s, self.nearest.last, self.nearest.k):
            self.nearest.add(i, d, j, objects)


def sparse_search(k: int) -> Search:
    return lambda q: _Records(q, k)


def knn_sparse(queries: DataFrame, database: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """The k nearest records of each query: both sides have key, classification, other, bin_keys, bin_values.

    Defaults may differ from record to record. Where one is not zero, all records have to
    end in the same bin; else bins beyond a record's last are zero. Bins ascend.
    """
    record = F.struct(F.col("other").cast("float").alias("other"), F.col("bin_keys").cast("array<int>").alias("bin_keys"), F.col("bin_values").cast("array<float>").alias("bin_values"))
    q, s = (df.select("key", "classification", record.alias("vector")) for df in (queries, database))
    return joined_by_blocks(q, s, k, sparse_search(k), block)

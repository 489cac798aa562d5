"""Hilbert indices: places on a curve whose neighbours are neighbours in space.

The published method (Skilling 2004): bit plane for bit plane, from the highest, the lower
bits of the coordinates are exchanged or inverted as the cell's orientation asks, then Gray
code is undone; the bits that result are interleaved like those of a Z-value. Rows are
transformed side by side.
"""

from __future__ import annotations

import numpy as np

from simjoin.functions import zorder


def _turned(x: np.ndarray, plane: int, axis: int) -> None:
    """Turns the cells of one plane: where the axis has the plane's bit, axis 0 is inverted below it, else exchanged with the axis."""
    below = np.uint32((1 << plane) - 1)
    inverted = (x[:, axis] >> np.uint32(plane) & np.uint32(1)).astype(bool)
    exchanged = np.where(inverted, 0, (x[:, 0] ^ x[:, axis]) & below).astype(np.uint32)
    x[:, 0] ^= np.where(inverted, below, exchanged)
    x[:, axis] ^= exchanged


def _parity_above(last: np.ndarray) -> np.ndarray:
    """For each plane, whether an odd number of the planes above it are set."""
    for by in (1, 2, 4, 8, 16):
        last = last ^ (last >> np.uint32(by))
    return last >> np.uint32(1)


def encode(coords: np.ndarray) -> list[bytes]:
    """Hilbert indices of rows of non-negative coordinates below 2**32."""
    x = coords.astype(np.uint32).copy()
    for plane in range(zorder.BITS - 1, 0, -1):
        for axis in range(x.shape[1]):
            _turned(x, plane, axis)
    x = np.bitwise_xor.accumulate(x, axis=1)
    return zorder.encode(x ^ _parity_above(x[:, -1])[:, None])


def decode(index: list[bytes], dim: int) -> np.ndarray:
    """The coordinates of Hilbert indices."""
    x = zorder.decode(index, dim).astype(np.uint32)
    first = x[:, 0] ^ (x[:, -1] >> np.uint32(1))
    x[:, 1:] ^= x[:, :-1].copy()
    x[:, 0] = first
    for plane in range(1, zorder.BITS):
        for axis in range(dim - 1, -1, -1):
            _turned(x, plane, axis)
    return x.astype(np.int64)

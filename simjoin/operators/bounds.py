"""Bounds on neighbour distances from pivots and cell statistics alone.

All arithmetic is in float64, and replication keeps a slack above the rounding of float32
distances, so that no bound cuts off a true neighbour.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from simjoin.functions.metric import Metric
from simjoin.operators.pivots import Voronoi

SLACK = 1e-5


def kth(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, k - 1)[k - 1]) if len(values) >= k else np.inf


def cell_upper(v: Voronoi, cell: int, cells: np.ndarray | None = None) -> float:
    """No query of the cell has its k-th neighbour farther than this (of objects of ``cells``)."""
    cells = np.arange(len(v.pivots)) if cells is None else cells
    reach = [v.query_max[cell] + v.distances[cell, s] + v.smallest[s] for s in cells if len(v.smallest[s])]
    return kth(np.concatenate(reach), v.k) if reach else np.inf


def upper_bounds(v: Voronoi, groups: np.ndarray, epsilon: float) -> np.ndarray:
    """The bound of each query cell over ``epsilon``; -inf for a cell without queries.

    Other than for an exact join only objects of the cell's own group count, because those
    reach the group whatever the bound.
    """
    out = np.full(len(groups), -np.inf)
    for c in np.flatnonzero(np.isfinite(v.query_max)):
        own = np.flatnonzero(groups == groups[c]) if epsilon != 1 else None
        bound = cell_upper(v, c, own)
        out[c] = (bound if np.isfinite(bound) else cell_upper(v, c) * epsilon) / epsilon
    return out


def _slack(x: np.ndarray) -> np.ndarray:
    return SLACK * (1 + np.abs(np.where(np.isfinite(x), x, 0)))


def cell_lower(v: Voronoi, cell: int, upper: np.ndarray) -> np.ndarray:
    """For each cell: an object nearer to its pivot than this is no neighbour of the queries of ``cell``."""
    low = v.distances[cell] - v.query_max[cell] - upper[cell]
    return low - _slack(low)


def lower_bounds(v: Voronoi, groups: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """cells x groups: an object nearer to its pivot than this is no neighbour of the group's queries."""
    out = np.full((len(groups), int(groups.max()) + 1), np.inf)
    for c in np.flatnonzero(np.isfinite(v.query_max)):
        out[:, groups[c]] = np.minimum(out[:, groups[c]], cell_lower(v, c, upper))
    return out


def region_box(v: Voronoi, cell: int, upper: np.ndarray) -> np.ndarray:
    """2 x static pivots: no neighbour of the cell's queries has distances to the static pivots outside of these.

    A neighbour is within the cell's bound of its query, and so, by the triangle inequality,
    are their distances to any pivot of each other.
    """
    low, high = v.query_box[cell, 0] - upper[cell], v.query_box[cell, 1] + upper[cell]
    return np.stack([low - _slack(low), high + _slack(high)])


@dataclass(frozen=True)
class Copies:
    """Of one group, for each cell: whether objects may be needed, from which distance to the pivot on, and in which box."""

    needed: np.ndarray
    low: np.ndarray
    box: np.ndarray


def group_copies(v: Voronoi, groups: np.ndarray, group: int, upper: np.ndarray, regions: bool = True) -> Copies:
    """Which objects a group may need: those that pass the lower bound and, with ``regions``, the cut regions of some of its query cells.

    A query cell counts for a database cell if the bound lets any of its objects pass and
    the two regions overlap. The group's own cells are needed whole, because bounds count on
    them.
    """
    low, hull = np.full(len(groups), np.inf), np.stack([np.full(v.db_box[:, 0].shape, np.inf), np.full(v.db_box[:, 0].shape, -np.inf)], axis=1)
    for c in np.flatnonzero((groups == group) & np.isfinite(v.query_max)):
        own = cell_lower(v, c, upper)
        counts = own <= v.db_max
        if regions:
            box = region_box(v, c, upper)
            counts &= (box[0] <= v.db_box[:, 1]).all(1) & (box[1] >= v.db_box[:, 0]).all(1)
            hull[counts] = np.stack([np.minimum(hull[counts, 0], box[0]), np.maximum(hull[counts, 1], box[1])], axis=1)
        low[counts] = np.minimum(low[counts], own[counts])
    whole = groups == group
    low[whole] = -np.inf
    if not regions:
        whole = np.ones(len(groups), bool)
    hull[whole] = np.array([[-np.inf], [np.inf]])
    return Copies((low <= v.db_max) & (v.db_n > 0), low, hull)


def beyond_plane(metric: Metric, d: np.ndarray, home: np.ndarray, between: np.ndarray) -> np.ndarray:
    """How far a query is at least from all objects that are nearer to another pivot than to its own.

    ``d`` and ``home`` are its distances to the two pivots, ``between`` theirs from each
    other. Any metric allows half the difference. In a space with the four-point property
    the pivots, the query and an object can be laid out with all their distances, and the
    query's distance to the plane between the pivots counts, which is never less.
    """
    if not getattr(metric, "four_point", False):
        return (d - home) / 2
    return np.where(between > 0, (d**2 - home**2) / (2 * np.where(between > 0, between, 1)), 0)


def query_upper(v: Voronoi, d: np.ndarray, cells: np.ndarray, most: int) -> float:
    """A bound for one query with distances ``d`` to the pivots, from its ``most`` nearest of ``cells``."""
    cells = cells[np.argsort(d[cells], kind="stable")][:most]
    reach = [d[s] + v.smallest[s] for s in cells if len(v.smallest[s])]
    return kth(np.concatenate(reach), v.k) if reach else np.inf

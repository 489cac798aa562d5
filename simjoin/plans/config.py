"""Parameters of the joins."""

from __future__ import annotations

from dataclasses import dataclass

METHODS = ("EXACT", "EPSILON_GUARANTEED", "APPROX", "QUERY_REP", "EPSILON_APPROX", "EXACT_BOUNDS", "APPROX_BOUNDS")


@dataclass(frozen=True)
class PivotConfig:
    pivot_count: int = 1000
    static_count: int = 10  # pivots whose distances bound cells; 0 for none
    max_rec_depth: int = 1  # nearest pivots of an object that count
    filter_ratio: float = 0.1  # share of cells that an approximate search visits
    method: str = "EXACT"  # of METHODS, in any case; another name means EXACT
    epsilon: float = 1.0
    exact_parent_filter: bool = True  # else objects are cut by the radius over epsilon too
    cut_copies: bool = True  # objects are copied only where the cut regions of cells allow it
    groups: int = 10  # at least
    group_objects: int | None = 100_000  # of the database, on average; more objects make more groups; None: as many groups as ``groups`` says
    travel_objects: int = 50_000  # a database with more is not copied: its queries travel instead
    seed: int = 937

    @property
    def variant(self) -> str:
        return self.method.upper() if self.method.upper() in METHODS else "EXACT"

    @property
    def max_buckets(self) -> int:
        return max(1, int(self.pivot_count * self.filter_ratio))


@dataclass(frozen=True)
class CurveConfig:
    curve: str = "z"  # or "hilbert"
    shifts: int = 2
    range: int = 500_000_000
    scale: float = 1e9
    entire_buckets: bool = True
    only_zorder: bool = False
    partitions: int = 10  # of each shift, at least
    range_objects: int = 1_000_000  # more objects make more ranges
    reach: int = 1  # a window search meets this many times k objects on either side
    seed: int = 937


@dataclass(frozen=True)
class LshConfig:
    tables: int = 2
    functions: int = 20
    w: float = 100.0
    multiplier: int = 2  # of the functions that are made for those that are kept
    seed: int = 100

"""Parameters of joins, indexes and encoders, with their usual values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from pathloom.sources.readers import extent


@dataclass(frozen=True)
class CellParams:
    """An index by cells: how many, how many a query asks, and the rows that centres are fitted on."""

    cells: int = 64
    probes: int = 8
    sample: int = 16_384
    rounds: int = 12


@dataclass(frozen=True)
class Context:
    """Extents and grid of a data set, for tokens."""

    min_ts: int
    max_ts: int
    min_x: float
    max_x: float
    min_y: float
    max_y: float
    ts_gap: int = 600_000
    x_cells: int = 200
    y_cells: int = 200

    @property
    def x_gap(self) -> float:
        return (self.max_x - self.min_x) / self.x_cells

    @property
    def y_gap(self) -> float:
        return (self.max_y - self.min_y) / self.y_cells


def context(points: DataFrame, **how) -> Context:
    """Extents from one aggregation of the points."""
    return Context(**extent(points).first().asDict(), **how)

"""Raster grid placement and probability byte encoding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotgrid.functions.spectral import clamp

NO_PROBABILITY = 255
PROBABILITY_STEPS = 254


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


@dataclass(frozen=True)
class Grid:
    """Affine north-up grid: x = x0 + col*dx, y = y0 - row*dy.

    Any field may be a Column (for instance a scalar subquery over the mask).
    """

    width: int | Column
    height: int | Column
    x0: float | Column = 0.0
    y0: float | Column = 0.0
    dx: float = 1.0
    dy: float = 1.0

    def x_of(self, col: Column) -> Column:
        return _lit(self.x0) + col * _lit(self.dx)

    def y_of(self, row: Column) -> Column:
        return _lit(self.y0) - row * _lit(self.dy)

    def centre_x(self, col: Column) -> Column:
        return self.x_of(col + 0.5)

    def centre_y(self, row: Column) -> Column:
        return self.y_of(row + 0.5)

    def col_at(self, x: Column) -> Column:
        return F.floor((x - _lit(self.x0)) / _lit(self.dx)).cast("int")

    def row_at(self, y: Column) -> Column:
        return F.floor((_lit(self.y0) - y) / _lit(self.dy)).cast("int")

    def shifted(self, row_off, col_off) -> "Grid":
        """The grid of a crop that starts at (row_off, col_off)."""
        return Grid(self.width, self.height, self.x_of(_lit(col_off)), self.y_of(_lit(row_off)), self.dx, self.dy)


def decode_probability(byte: Column) -> Column:
    """Stored byte to [0, 1]; "no probability" reads as 0."""
    return F.when(byte == NO_PROBABILITY, 0.0).otherwise(byte / float(PROBABILITY_STEPS))


def encode_probability(prob: Column) -> Column:
    """[0, 1] to a stored byte, null to "no probability"."""
    code = F.floor(clamp(prob, 0.0, 1.0) * float(PROBABILITY_STEPS) + 0.5)
    return F.coalesce(code, F.lit(NO_PROBABILITY)).cast("smallint")

"""Grids and the algebra of their cells, as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """North-up regular grid: columns of width a from longitude c, rows of height e < 0 from latitude f."""

    name: str
    width: int
    height: int
    c: float
    a: float
    f: float
    e: float

    @property
    def bbox(self) -> tuple[float, float, float, float]:
        """west, south, east, north"""
        return self.c, self.f + self.height * self.e, self.c + self.width * self.a, self.f

    def same_as(self, other: Grid, places: int = 12) -> bool:
        own, their = (tuple(round(v, places) for v in (g.c, g.a, g.f, g.e)) for g in (self, other))
        return own == their and (self.width, self.height) == (other.width, other.height)

    def nests(self, coarse: Grid) -> int:
        """How many of these cells lie along the side of one of the coarse grid's; an error if they don't nest."""
        n = round(coarse.a / self.a)
        if n < 1 or abs(coarse.a - n * self.a) > 1e-9 or abs(coarse.e - n * self.e) > 1e-9:
            raise ValueError(f"{self.name} doesn't nest in {coarse.name}")
        return n

    def row(self, lat: Column) -> Column:
        return F.floor((lat - F.lit(self.f)) / F.lit(self.e)).cast("int")

    def col(self, lon: Column) -> Column:
        return F.floor((lon - F.lit(self.c)) / F.lit(self.a)).cast("int")

    def inside(self, row: Column, col: Column) -> Column:
        return row.between(0, self.height - 1) & col.between(0, self.width - 1)

    def cell_id(self, row: Column, col: Column) -> Column:
        return row.cast("bigint") * F.lit(self.width).cast("bigint") + col

    def row_of(self, cell: Column) -> Column:
        return F.floor(cell / F.lit(self.width)).cast("int")

    def col_of(self, cell: Column) -> Column:
        return F.pmod(cell, F.lit(self.width).cast("bigint")).cast("int")

    def centre_lat(self, row: Column) -> Column:
        return F.lit(self.f) + (row + F.lit(0.5)) * F.lit(self.e)

    def centre_lon(self, col: Column) -> Column:
        return F.lit(self.c) + (col + F.lit(0.5)) * F.lit(self.a)

    def box(self, lat: Column, lon: Column) -> Column:
        """Corner box of the cell of a point; null outside the grid."""
        row, col = self.row(lat), self.col(lon)
        edge = lambda o, i, s: F.lit(o) + i * F.lit(s)
        return F.when(self.inside(row, col), F.struct(edge(self.c, col, self.a).alias("west"), edge(self.f, row + 1, self.e).alias("south"), edge(self.c, col + 1, self.a).alias("east"), edge(self.f, row, self.e).alias("north")))

    def window(self, west: float, south: float, east: float, north: float, pad: int = 0) -> tuple[int, int, int, int]:
        """First and last row, first and last column that an extent touches, clipped to the grid; an error if there are none."""
        from math import ceil, floor

        tidy = lambda x: round(x, 9)
        r0, r1 = floor(tidy((north - self.f) / self.e)) - pad, ceil(tidy((south - self.f) / self.e)) - 1 + pad
        c0, c1 = floor(tidy((west - self.c) / self.a)) - pad, ceil(tidy((east - self.c) / self.a)) - 1 + pad
        out = max(r0, 0), min(r1, self.height - 1), max(c0, 0), min(c1, self.width - 1)
        if out[0] > out[1] or out[2] > out[3]:
            raise ValueError("the extent lies outside the grid")
        return out


# The grids of the data model.
USA_30S = Grid("USA_30s", 7020, 3060, -125.0, 1 / 120, 49.5, -1 / 120)
FRA_30S = Grid("FRA_30s", 1860, 1260, -5.5, 1 / 120, 51.5, -1 / 120)
GLOBAL_10M = Grid("GLOBAL_10m", 2160, 1080, -180.0, 1 / 6, 90.0, -1 / 6)
PROFILES = {g.name: g for g in (USA_30S, FRA_30S, GLOBAL_10M)}


def snap_out(west: float, south: float, east: float, north: float, grid: Grid) -> tuple[float, float, float, float]:
    """The smallest extent on the grid's lattice that holds the extent."""
    from math import ceil, floor

    r = lambda x: round(x, 9)
    return (
        grid.c + floor(r((west - grid.c) / grid.a)) * grid.a,
        grid.f + ceil(r((south - grid.f) / grid.e)) * grid.e,
        grid.c + ceil(r((east - grid.c) / grid.a)) * grid.a,
        grid.f + floor(r((north - grid.f) / grid.e)) * grid.e,
    )

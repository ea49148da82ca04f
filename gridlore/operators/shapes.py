"""Polygons as nested arrays of rings of (x, y): areas, parts, and the cells that they touch."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import Grid


def ring_area(ring: Column) -> Column:
    """Shoelace area of an array of (x, y) structs, narrowed by the cosine of the mean latitude."""
    n = F.size(ring)
    at = lambda i, k: F.get(ring, i % n)[k]
    twice = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda a, i: a + at(i, "x") * at(i + 1, "y") - at(i + 1, "x") * at(i, "y"))
    mean = F.aggregate(ring, F.lit(0.0), lambda a, p: a + p["y"]) / n
    return F.abs(twice) / 2 * F.cos(F.radians(F.greatest(F.least(mean, F.lit(89.0)), F.lit(-89.0))))


def part_areas(parts: DataFrame) -> DataFrame:
    """(shape, part, rings) -> area: the outer ring less its holes."""
    holes = F.aggregate(F.slice("rings", 2, F.size("rings")), F.lit(0.0), lambda a, r: a + ring_area(r))
    return parts.withColumn("area", ring_area(F.get("rings", 0)) - holes)


def largest_parts(areas: DataFrame, share: float) -> DataFrame:
    """The largest parts of each shape that together first reach the share of its area."""
    w = Window.partitionBy("shape").orderBy(F.col("area").desc(), "part")
    before = F.sum("area").over(w) - F.col("area")
    return areas.withColumn("_b", before).withColumn("_t", F.sum("area").over(Window.partitionBy("shape"))).where(F.col("_b") < share * F.col("_t")).drop("_b", "_t")


def cluster_parts(parts: DataFrame, most_gap: float = 10.0) -> DataFrame:
    """Of each shape the parts (shape, part, area, west, south, east, north) that hang together with its largest: in rounds, parts whose box lies at most most_gap from the box around those
    gathered so far join them, until none does. A round is one aggregate of a row for each shape, which is sent to the parts; there are as many rounds as the longest chain of parts."""
    sides = ("west", "south", "east", "north")
    first = parts.groupBy("shape").agg(F.max_by(F.struct(*sides), F.struct("area", -F.col("part"))).alias("_b"))
    box, before = first.select("shape", *[F.col(f"_b.{c}").alias(f"_{c}") for c in sides]), None
    apart = lambda low, high: F.greatest(F.col(f"_{low}") - F.col(high), F.col(low) - F.col(f"_{high}"), F.lit(0.0))
    while True:
        near = parts.join(F.broadcast(box), "shape").where(F.hypot(apart("west", "east"), apart("south", "north")) <= most_gap)
        grown = near.groupBy("shape").agg(*[(F.min if c in ("west", "south") else F.max)(c).alias(f"_{c}") for c in sides], F.count("*").alias("_n"))
        rows = grown.collect()  # a row for each shape
        if (now := sorted((r["shape"], r["_n"]) for r in rows)) == before:
            return near.drop(*[f"_{c}" for c in sides])
        before = now
        box = parts.sparkSession.createDataFrame(rows, grown.schema).drop("_n")


def touched_cells(rings: list[list[tuple[float, float]]], grid: Grid) -> np.ndarray:
    """(row, col) of cells that a polygon's inside or outline touches; the polygon has few vertices, its rows are scanned with numpy."""
    xs = [np.array([(p[0] - grid.c) / grid.a for p in r]) for r in rings]
    ys = [np.array([(p[1] - grid.f) / grid.e for p in r]) for r in rings]
    out = set()
    for x, y in zip(xs, ys):  # outlines: cells between the crossings of grid lines
        for x0, y0, x1, y1 in zip(x, y, np.roll(x, -1), np.roll(y, -1)):
            cuts = [0.0, 1.0]
            for a, b in ((x0, x1), (y0, y1)):
                if a != b:
                    lines = np.arange(math.floor(min(a, b)) + 1, math.ceil(max(a, b)))
                    cuts += ((lines - a) / (b - a)).tolist()
            t = np.unique(np.clip(cuts, 0, 1))
            mid = (t[1:] + t[:-1]) / 2
            out |= set(zip(np.floor(y0 + mid * (y1 - y0)).astype(int).tolist(), np.floor(x0 + mid * (x1 - x0)).astype(int).tolist()))
    top, bottom = math.floor(min(map(np.min, ys))), math.ceil(max(map(np.max, ys)))
    for row in range(top, bottom):  # inside: centres by crossings of each row's middle
        m, cross = row + 0.5, []
        for x, y in zip(xs, ys):
            x1, y1 = np.roll(x, -1), np.roll(y, -1)
            hit = (y <= m) != (y1 <= m)
            cross += (x[hit] + (m - y[hit]) / (y1[hit] - y[hit]) * (x1[hit] - x[hit])).tolist()
        cross.sort()
        for a, b in zip(cross[::2], cross[1::2]):
            out |= {(row, c) for c in range(math.ceil(a - 0.5), math.floor(b - 0.5) + 1)}
    return np.array(sorted(p for p in out if 0 <= p[0] < grid.height and 0 <= p[1] < grid.width)).reshape(-1, 2)


def within(cells: DataFrame, shape_cells: DataFrame) -> DataFrame:
    """Cells of a shape's cell set: a semi-join."""
    return cells.join(shape_cells.select("grid_row", "grid_col").distinct(), ["grid_row", "grid_col"], "left_semi")

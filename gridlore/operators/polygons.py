"""Polygons over a grid as a scan-line join: a table of shapes of any number, holes included, to the cells that they cover or touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import Grid
from .cells import CELL


def edges(vertices: DataFrame, grid: Grid) -> DataFrame:
    """(shape, ring, seq, x, y) -> an edge for each vertex, to the next of its ring (the last to the first), in fractional columns and rows: (shape, u1, v1, u2, v2).

    Rings of one shape are outlines and holes alike: what lies within an odd number of them is inside. Null vertices are left out.
    """
    ring = Window.partitionBy("shape", "ring").orderBy("seq")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = vertices.where("x is not null and y is not null").select("shape", "ring", "seq", ((F.col("x") - grid.c) / grid.a).alias("u1"), ((F.col("y") - grid.f) / grid.e).alias("v1"))
    to = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(whole))
    return at.select("shape", "u1", "v1", to("u1").alias("u2"), to("v1").alias("v2"))


def _up_to(first: Column, last: Column) -> Column:
    """Whole numbers from first to last; none where last is smaller."""
    return F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>")))


def _along(v: Column) -> Column:
    """Where an edge is at row coordinate v."""
    return F.col("u1") + (v - F.col("v1")) * (F.col("u2") - F.col("u1")) / (F.col("v2") - F.col("v1"))


def covered_cells(vertices: DataFrame, grid: Grid, all_touched: bool = True) -> DataFrame:
    """(shape, grid_row, grid_col), once each: cells whose centre is inside, and with all_touched those that the outline passes through.

    Edges are exploded to the rows whose centre line they cross; the crossings of a row, in order, are ends of spans in turn, exploded to columns. Outlines are exploded to the rows that they pass and,
    in each, to the columns between entry and exit. Rows and columns outside of the grid are cut off before anything is exploded, so work grows with what a shape covers of the grid. A
    window holds the crossings of one row of one shape.
    """
    e = edges(vertices, grid)
    low, high = F.least("v1", "v2"), F.greatest("v1", "v2")
    clip = lambda first, last, n: (F.greatest(first, F.lit(0)).cast("int"), F.least(last, F.lit(n - 1)).cast("int"))
    lines = e.withColumn("grid_row", _up_to(*clip(F.ceil(low - 0.5), F.ceil(high - 0.5) - 1, grid.height)))
    crossings = lines.select("shape", "grid_row", _along(F.col("grid_row") + 0.5).alias("u"))
    order = Window.partitionBy("shape", "grid_row").orderBy("u")
    spans = crossings.select("shape", "grid_row", "u", F.lead("u").over(order).alias("w"), F.row_number().over(order).alias("k")).where("k % 2 = 1 and w is not null")
    inside = spans.select("shape", "grid_row", _up_to(*clip(F.ceil(F.col("u") - 0.5), F.ceil(F.col("w") - 0.5) - 1, grid.width)).alias("grid_col"))
    if not all_touched:
        return inside.distinct().hint("merge")  # nothing is shuffled after the spans are exploded, so Spark's estimate is too low to broadcast by
    passed = e.withColumn("grid_row", _up_to(*clip(F.floor(low), F.floor(high), grid.height)))
    ends = [F.when(F.col("v1") == F.col("v2"), c).otherwise(_along(F.greatest(F.least(v, F.col("grid_row") + 1.0), F.col("grid_row").cast("double")))) for c, v in ((F.col("u1"), F.col("v1")), (F.col("u2"), F.col("v2")))]
    outline = passed.select("shape", "grid_row", _up_to(*clip(F.floor(F.least(*ends)), F.floor(F.greatest(*ends)), grid.width)).alias("grid_col"))
    return inside.unionByName(outline).distinct()


def clip_to_shape(cells: DataFrame, vertices: DataFrame, grid: Grid, source: Grid | None = None, all_touched: bool = True) -> DataFrame:
    """Cells of the shapes of ``vertices``, with their shape; nothing is resampled. source: the lattice the cells' keys are on, if it is a larger one; it must agree with the grid's."""
    if source is not None:
        rows, cols = offset(source, grid)
        cells = cells.withColumns({"grid_row": F.col("grid_row") - rows, "grid_col": F.col("grid_col") - cols})
    return cells.join(covered_cells(vertices, grid, all_touched), CELL)


def offset(source: Grid, clip: Grid) -> tuple[int, int]:
    """Rows and columns from a grid to a window of it; an error if the window's cells aren't the grid's."""
    rows, cols = (clip.f - source.f) / source.e, (clip.c - source.c) / source.a
    if abs(clip.a - source.a) > 1e-9 or abs(clip.e - source.e) > 1e-9 or abs(rows - round(rows)) > 1e-6 or abs(cols - round(cols)) > 1e-6:
        raise ValueError(f"{clip.name} is not a window of {source.name}: cells lie {rows:.6f} rows and {cols:.6f} columns off")
    rows, cols = round(rows), round(cols)
    if rows < 0 or cols < 0 or rows + clip.height > source.height or cols + clip.width > source.width:
        raise ValueError(f"{clip.name} reaches beyond {source.name}")
    return rows, cols


def preferred_shapes(shapes: DataFrame, keys: list[str], wanted: str) -> DataFrame:
    """Of the shapes (key columns, area) that carry the wanted code in one of the keys, those of the first key that has any, largest first."""
    hit = F.coalesce(*[F.when(F.col(k) == wanted, F.lit(i)) for i, k in enumerate(keys)])
    found = shapes.withColumn("_key", hit).where("_key is not null")
    first = found.agg(F.min("_key").alias("_first"))
    return found.join(F.broadcast(first), F.col("_key") == F.col("_first")).drop("_key", "_first").orderBy(F.col("area").desc())  # one row

"""Area-average warp between lattices: weights are products of one-dimensional overlaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import Grid


def _met(first: Column, last: Column, n: int) -> Column:
    """The target rows or columns that a source cell from first to last (in target units) overlaps, with the length of the overlap."""
    lo, hi = F.greatest(F.floor(first), F.lit(0)).cast("int"), F.least(F.ceil(last) - 1, F.lit(n - 1)).cast("int")
    span = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    parts = F.transform(span, lambda k: F.struct(k.alias("k"), (F.least(last, k + 1.0) - F.greatest(first, k.cast("double"))).alias("w")))
    return F.explode(F.filter(parts, lambda p: p["w"] > 0))


def area_average(cells: DataFrame, source: Grid, target: Grid, columns: Sequence[str]) -> DataFrame:
    """(grid_row, grid_col, columns, share) on the target: means of the source's cells by the area in common, nulls left out of each column's; share: how much of the target cell has source cells.

    A source cell is exploded to the target cells that it overlaps, rows and columns each for themselves, and summed before the shuffle; there is no join. Cells without source are absent.
    """
    top, left = (source.f - target.f) / target.e, (source.c - target.c) / target.a
    tall, wide = source.e / target.e, source.a / target.a
    at = cells.withColumn("_r", _met(F.lit(top) + F.col("grid_row") * tall, F.lit(top) + (F.col("grid_row") + 1) * tall, target.height))
    at = at.withColumn("_c", _met(F.lit(left) + F.col("grid_col") * wide, F.lit(left) + (F.col("grid_col") + 1) * wide, target.width))
    w = F.col("_r.w") * F.col("_c.w")
    means = [F.try_divide(F.sum(F.col(c) * w), F.sum(F.when(F.col(c).isNotNull(), w))).alias(c) for c in columns]
    return at.groupBy(F.col("_r.k").alias("grid_row"), F.col("_c.k").alias("grid_col")).agg(*means, F.sum(w).alias("share"))

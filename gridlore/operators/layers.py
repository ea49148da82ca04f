"""Layer tables as a whole: units, tiles with halos, unions of point and layer sets, the order of aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .landcover import horn


def scaled(values: DataFrame, scales: DataFrame, key: str = "layer", value: str = "value", divisor: str = "divisor") -> DataFrame:
    """values (layer, value, ..) in their units: divided by the layer's divisor; layers without one, or with zero, stay as they are. scales has a row for each layer."""
    d = scales.select(key, F.col(divisor).cast("double").alias("_d")).where("_d <> 0")
    return values.join(F.broadcast(d), key, "left").withColumn(value, F.col(value) / F.coalesce("_d", F.lit(1.0))).drop("_d")


def tiles(cells: DataFrame, step: int, halo: int = 0, row: str = "grid_row", col: str = "grid_col") -> DataFrame:
    """Each cell with the tile (tile_row, tile_col) it lies in, and again with the neighbouring tiles whose halo it lies in (own false).

    A tile has step rows and columns; a halo of at most step reaches up to eight neighbours, by an explode of offsets: no join.
    """
    if not 0 <= halo <= step:
        raise ValueError("a halo has 0 to step cells")
    sides = F.sequence(F.lit(-1), F.lit(1)) if halo else F.array(F.lit(0))
    out = cells.withColumns({"_i": F.explode(sides)}).withColumns({"_j": F.explode(sides)})
    tile = lambda c, off: F.floor(F.col(c) / step).cast("int") + F.col(off)
    out = out.withColumns({"tile_row": tile(row, "_i"), "tile_col": tile(col, "_j")})
    within = lambda c, t: F.col(c).between(F.col(t) * step - halo, F.col(t) * step + step - 1 + halo)
    kept = out.where(within(row, "tile_row") & within(col, "tile_col") & (F.col("tile_row") >= 0) & (F.col("tile_col") >= 0))
    return kept.withColumn("own", (F.col("_i") == 0) & (F.col("_j") == 0)).drop("_i", "_j")


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """The rows of all parts by column name; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def labelled(presence: DataFrame, background: DataFrame, out: str = "y") -> DataFrame:
    """Presence rows with 1 and background rows with 0."""
    return union_all([presence.withColumn(out, F.lit(1)), background.withColumn(out, F.lit(0))])


def layer_union(a: DataFrame, b: DataFrame, key: str = "layer", value: str = "value") -> DataFrame:
    """Every layer of either table with both values."""
    return a.select(key, F.col(value).alias(f"{value}_a")).join(b.select(key, F.col(value).alias(f"{value}_b")), key, "full_outer")


def mapped_overlay(rows: DataFrame, checklist: DataFrame, mapping: dict[str, dict[str, str]], key: str = "species") -> DataFrame:
    """Columns of a checklist over those of rows, only for names that rows has: a value is translated by the column's dictionary, one it lacks changes nothing."""
    own = checklist.select(key, *[F.col(c).alias(f"_{c}") for c in mapping]).dropDuplicates([key])
    out = rows.join(own, key, "left")
    for c, words in mapping.items():
        table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv]) if words else F.create_map().cast("map<string,string>")
        out = out.withColumn(c, F.coalesce(F.try_element_at(table, F.lower(F.trim(f"_{c}"))), F.col(c)))
    return out.drop(*[f"_{c}" for c in mapping])


def slope_order(cells: DataFrame, z: str, n: int, cell_m: float, lat_of: Column, coarse_lat_of: Column) -> DataFrame:
    """By block of n by n cells: mean and 90th percentile of the cells' slopes, the slope of the averaged surface, and the ratio of the first to the last."""
    block = lambda c: F.floor(F.col(c) / n).cast("int")
    native = horn(cells, z, cell_m, lat_of).groupBy(block("grid_row").alias("r"), block("grid_col").alias("c"))
    native = native.agg(F.avg("slope").alias("mean_slope"), F.percentile("slope", F.lit(0.9)).alias("p90_slope"))
    flat = cells.groupBy(block("grid_row").alias("grid_row"), block("grid_col").alias("grid_col")).agg(F.avg(z).alias(z))
    flat = horn(flat, z, cell_m * n, coarse_lat_of).select(F.col("grid_row").alias("r"), F.col("grid_col").alias("c"), F.col("slope").alias("slope_of_mean"))
    both = native.join(flat, ["r", "c"]).where("mean_slope is not null and slope_of_mean is not null")
    return both.select(F.col("r").alias("grid_row"), F.col("c").alias("grid_col"), "mean_slope", "p90_slope", "slope_of_mean", F.try_divide("mean_slope", "slope_of_mean").alias("ratio"))


def agreement(a: DataFrame, published: DataFrame, keys: Sequence[str], value: str, other: str) -> DataFrame:
    """One row: cells valid in both, and the correlation of a layer with a published one."""
    return a.select(*keys, value).join(published.select(*keys, other), list(keys)).where(F.col(value).isNotNull() & F.col(other).isNotNull()).agg(F.count("*").alias("n"), F.corr(value, other).alias("corr"))

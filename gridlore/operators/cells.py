"""Joins of points and cells: grid lookups, overlays, merges of cell sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import Grid

CELL = ["grid_row", "grid_col"]


def lookup(points: DataFrame, cells: DataFrame, layers: Sequence[str]) -> DataFrame:
    """The layers at each point's cell; off the grid or without a cell all are null. An equi-join on row and column."""
    return points.join(cells.select(*CELL, *layers), CELL, "left")


def lookup_coarse(fine: DataFrame, coarse: DataFrame, ratio: int, layers: Sequence[str]) -> DataFrame:
    """Nearest value of a coarse grid that the fine one nests in: a join on derived keys."""
    keyed = fine.withColumns({"_r": F.floor(F.col("grid_row") / ratio).cast("int"), "_c": F.floor(F.col("grid_col") / ratio).cast("int")})
    right = coarse.select(F.col("grid_row").alias("_r"), F.col("grid_col").alias("_c"), *layers)
    return keyed.join(right, ["_r", "_c"], "left").drop("_r", "_c")


def invalid_cells(points: DataFrame, cells: DataFrame, column: str, grid: Grid, out: str = "invalid_cell") -> DataFrame:
    """Off the grid, or the layer has no value there."""
    hit = lookup(points, cells, [column])
    return hit.withColumn(out, ~F.coalesce(grid.inside(F.col("grid_row"), F.col("grid_col")), F.lit(False)) | F.col(column).isNull()).drop(column)


def ocean(points: DataFrame, land: DataFrame | None, column: str = "land_pct", out: str = "ocean") -> DataFrame:
    """Land share under 1 % or unknown; without a land layer nothing is flagged."""
    if land is None:
        return points.withColumn(out, F.lit(False))
    return lookup(points, land, [column]).withColumn(out, ~F.coalesce(F.col(column) >= 1, F.lit(False))).drop(column)


def presence_pairs(points: DataFrame) -> DataFrame:
    """Distinct (species, cell_id)."""
    return points.select("species", "cell_id").distinct()


def shared_universe(universe: DataFrame, presence: DataFrame, species: str) -> DataFrame:
    """Every cell of the universe with y = 1 where the species is present."""
    own = presence.where(F.col("species") == species).select("cell_id").distinct().withColumn("_y", F.lit(1))
    return universe.join(own, "cell_id", "left").withColumn("y", F.coalesce("_y", F.lit(0))).drop("_y")


def cell_table(presence: DataFrame, background: DataFrame, surveyed: DataFrame | None = None) -> DataFrame:
    """Merge of presence and background cells: has_record, is_background, surveyed, mask = greater of record and survey."""
    p = presence.select("cell_id").distinct().withColumn("_p", F.lit(1))
    b = background.select("cell_id").distinct().withColumn("_b", F.lit(1))
    out = p.join(b, "cell_id", "full_outer").select("cell_id", F.coalesce("_p", F.lit(0)).alias("has_record"), F.coalesce("_b", F.lit(0)).alias("is_background"))
    if surveyed is None:
        return out.withColumn("surveyed", F.col("is_background")).withColumn("mask", F.greatest("has_record", "surveyed"))
    s = surveyed.select("cell_id").distinct().withColumn("_s", F.lit(1))
    return out.join(s, "cell_id", "left").withColumn("surveyed", F.coalesce("_s", F.lit(0))).drop("_s").withColumn("mask", F.greatest("has_record", "surveyed"))


def multi_hot(presence: DataFrame, species: Sequence[str]) -> DataFrame:
    """A column for each of a given short list of species: only for small demonstrations, elsewhere presence stays sparse."""
    return presence.groupBy("cell_id").pivot("species", list(species)).agg(F.lit(1)).na.fill(0)


def overlay(base: DataFrame, extra: DataFrame, key: str, columns: Sequence[str], append: bool = True) -> DataFrame:
    """extra's values over base's where they aren't null; rows that base lacks are appended."""
    e = extra.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    j = base.join(e, F.col(key) == F.col("_key"), "full_outer" if append else "left")
    return j.select(F.coalesce(key, "_key").alias(key), *[F.coalesce(f"_{c}", c).alias(c) for c in columns])


def precedence(primary: DataFrame, backup: DataFrame, key: str, column: str) -> DataFrame:
    """The primary's value, else the backup's; source 1 or 2, 0 without a value."""
    j = primary.select(key, F.col(column).alias("_p")).join(backup.select(key, F.col(column).alias("_b")), key, "full_outer")
    return j.select(key, F.coalesce("_p", "_b").alias(column), F.when(F.col("_p").isNotNull(), 1).when(F.col("_b").isNotNull(), 2).otherwise(0).alias("source"))


def common_validity(tables: Sequence[DataFrame], key: str, columns: Sequence[str]) -> DataFrame:
    """Cells where every compared layer has a value."""
    parts = [t.select(key, c).where(F.col(c).isNotNull()) for t, c in zip(tables, columns)]
    return reduce(lambda a, b: a.join(b, key), parts)


def faithful(clip: DataFrame, source: DataFrame, column: str, row_shift: int, col_shift: int) -> DataFrame:
    """One row: cells compared of a clip and its source on shifted keys, equal (nulls equal), and missing on either side."""
    s = source.select((F.col("grid_row") - row_shift).alias("grid_row"), (F.col("grid_col") - col_shift).alias("grid_col"), F.col(column).alias("_s"), F.lit(True).alias("_in_source"))
    j = clip.select(*CELL, F.col(column).alias("_c"), F.lit(True).alias("_in_clip")).join(s, CELL, "left")
    return j.agg(F.count("*").alias("n"), F.sum(F.col("_c").eqNullSafe(F.col("_s")).cast("int")).alias("n_equal"), F.sum(F.col("_in_source").isNull().cast("int")).alias("n_outside"))


def ring_fallback(points: DataFrame, cells: DataFrame, column: str, radius: int = 2) -> DataFrame:
    """The value at the point's cell, else the first in row-major order on the nearest square ring that has one.

    Rings are searched once for each cell that holds points. Spark's estimate doesn't count exploded rows, so these are kept out of broadcasts; points are the outer side of joins, which is never broadcast.
    """
    offsets = F.array(*[F.struct(F.lit(max(abs(i), abs(j))).alias("ring"), F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)])
    near = points.select(*CELL).distinct().select(*CELL, F.inline(offsets)).withColumns({"_r": F.col("grid_row") + F.col("dr"), "_c": F.col("grid_col") + F.col("dc")})
    hit = near.hint("merge").join(cells.where(F.col(column).isNotNull()).select(F.col("grid_row").alias("_r"), F.col("grid_col").alias("_c"), column), ["_r", "_c"])
    order = F.struct("ring", "_r", "_c").alias("order")
    by_cell = hit.groupBy(*CELL).agg(F.min_by(F.struct(column, order), order).alias("x"))
    best = points.select("rid", *CELL).join(by_cell, CELL, "left").groupBy("rid").agg(F.min_by("x", "x.order").alias("x"))
    return points.select("rid").join(best, "rid", "left").select("rid", F.col(f"x.{column}").alias(column), F.col("x.order.ring").alias("ring"))


def nearest_cells(cells: DataFrame, lat: float, lon: float, grid: Grid, most_km: float = 25.0, stride: int = 1, k: int = 48) -> DataFrame:
    """The k nearest cells within most_km on a lattice of every stride-th row and column."""
    from math import ceil, cos, floor, radians

    from ..functions.scalar import KM_LAT, KM_LON, flat_km

    r0, c0 = floor((lat - grid.f) / grid.e), floor((lon - grid.c) / grid.a)
    dr, dc = ceil(most_km / KM_LAT / grid.a) + 1, ceil(most_km / (KM_LON * max(0.05, cos(radians(lat)))) / grid.a) + 1
    box = cells.where(F.col("grid_row").between(r0 - dr, r0 + dr) & F.col("grid_col").between(c0 - dc, c0 + dc))
    box = box.where((F.col("grid_row") % stride == 0) & (F.col("grid_col") % stride == 0))
    km = flat_km(F.lit(lat), F.lit(lon), grid.centre_lat(F.col("grid_row")), grid.centre_lon(F.col("grid_col")))
    return box.withColumn("km", km).where(F.col("km") <= most_km).orderBy("km", "grid_row", "grid_col").limit(k)


def separated(candidates: DataFrame, grid: Grid, least_km: float = 6.0, keep: int = 3) -> list:
    """Greedy choice by order among a short list (nearest_cells): each at least least_km from those before."""
    from math import cos, hypot, radians

    from ..functions.scalar import KM_LAT, KM_LON

    chosen: list = []
    for r in candidates.collect():  # k rows
        at = grid.f + (r["grid_row"] + 0.5) * grid.e, grid.c + (r["grid_col"] + 0.5) * grid.a
        if all(hypot((at[1] - o[1]) * KM_LON * cos(radians((at[0] + o[0]) / 2)), (at[0] - o[0]) * KM_LAT) >= least_km for _, o in chosen):
            chosen.append((r, at))
        if len(chosen) == keep:
            break
    return [r for r, _ in chosen]


def tile_accumulate(pixels: DataFrame, grid: Grid) -> DataFrame:
    """Spread counts of lon/lat boxes (west, south, east, north, n; no wider than a cell) over the up to four cells they touch, by area; longitudes wrap.

    Each box is exploded to four corner offsets with area shares: no range join.
    """
    x0, x1 = (F.col("west") - grid.c) / grid.a, (F.col("east") - grid.c) / grid.a
    y0, y1 = (F.col("north") - grid.f) / grid.e, (F.col("south") - grid.f) / grid.e
    p = pixels.withColumns({"_c": F.floor(x0), "_r": F.floor(y0), "_x0": x0, "_x1": x1, "_y0": y0, "_y1": y1})
    p = p.withColumn("_d", F.explode(F.array(*[F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i in (0, 1) for j in (0, 1)])))
    row, col = F.col("_r") + F.col("_d.dr"), F.col("_c") + F.col("_d.dc")
    w = F.greatest(F.least("_x1", col + 1) - F.greatest("_x0", col), F.lit(0.0)) / (F.col("_x1") - F.col("_x0"))
    h = F.greatest(F.least("_y1", row + 1) - F.greatest("_y0", row), F.lit(0.0)) / (F.col("_y1") - F.col("_y0"))
    p = p.withColumns({"grid_row": row.cast("int"), "grid_col": F.pmod(col, F.lit(grid.width)).cast("int"), "_n": F.col("n") * w * h}).where("_n > 0")
    return p.where(F.col("grid_row").between(0, grid.height - 1)).groupBy(*CELL).agg(F.sum("_n").alias("total"))


def tiles_in(tiles: DataFrame, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Tiles whose open box meets the extent's."""
    west, south, east, north = bbox
    return tiles.where((F.col("west") < east) & (F.col("east") > west) & (F.col("south") < north) & (F.col("north") > south))


def block_mean(cells: DataFrame, n: int, columns: Sequence[str]) -> DataFrame:
    """Means of n by n blocks, nulls left out."""
    return cells.groupBy(F.floor(F.col("grid_row") / n).cast("int").alias("grid_row"), F.floor(F.col("grid_col") / n).cast("int").alias("grid_col")).agg(*[F.avg(c).alias(c) for c in columns])


def shift_clip(cells: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """A window as a grid of its own: keys shifted, nothing resampled."""
    inside = cells.where(F.col("grid_row").between(*rows) & F.col("grid_col").between(*cols))
    return inside.withColumns({"grid_row": F.col("grid_row") - rows[0], "grid_col": F.col("grid_col") - cols[0]})


def pad_to(cells: DataFrame, height: int, width: int) -> DataFrame:
    """All cells of a height by width grid, those without a row as nulls."""
    spark = cells.sparkSession
    full = spark.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("grid_row"), (F.col("id") % width).cast("int").alias("grid_col"))
    return full.join(cells, CELL, "left")


def bilinear(coarse: DataFrame, column: str, points: DataFrame) -> DataFrame:
    """Values at fractional (y, x) cell coordinates of points (rid, y, x): the four neighbours by their weights, null neighbours left out. Exploded rows stay out of broadcasts."""
    y, x = F.col("y") - 0.5, F.col("x") - 0.5
    p = points.select("rid", F.floor(y).cast("int").alias("_r"), F.floor(x).cast("int").alias("_c"), (y - F.floor(y)).alias("_fy"), (x - F.floor(x)).alias("_fx"))
    p = p.select("*", F.inline(F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(j).alias("_j")) for i in (0, 1) for j in (0, 1)])))
    w = F.when(F.col("_i") == 1, F.col("_fy")).otherwise(1 - F.col("_fy")) * F.when(F.col("_j") == 1, F.col("_fx")).otherwise(1 - F.col("_fx"))
    p = p.select("rid", (F.col("_r") + F.col("_i")).alias("grid_row"), (F.col("_c") + F.col("_j")).alias("grid_col"), w.alias("_w"))
    hit = p.hint("merge").join(coarse.where(F.col(column).isNotNull()).select(*CELL, column), CELL)
    return points.select("rid").join(hit.groupBy("rid").agg(F.try_divide(F.sum(F.col(column) * F.col("_w")), F.sum("_w")).alias(column)), "rid", "left")




def bilinear_filled(coarse: DataFrame, column: str, points: DataFrame) -> DataFrame:
    """Bilinear values; where none of the four neighbours has one, the nearest cell on the rings around the point's own."""
    at = points.select("rid", F.floor("y").cast("int").alias("grid_row"), F.floor("x").cast("int").alias("grid_col"))
    near = ring_fallback(at, coarse, column, 2).select("rid", F.col(column).alias("_near"))
    return bilinear(coarse, column, points).join(near, "rid").select("rid", F.coalesce(column, "_near").alias(column))


def synonyms(names: DataFrame, keys: DataFrame, plan: DataFrame) -> DataFrame:
    """name -> usage key -> plan record, by two equi-joins."""
    return names.join(keys, "species").join(plan, "usageKey").select("species", *[c for c in plan.columns if c != "usageKey"])


def unmatched(base: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Rows of extra whose key base lacks, appended to base."""
    return base.unionByName(extra.join(base.select(key), key, "left_anti"), allowMissingColumns=True)


def dedupe_two_keys(df: DataFrame, first: str, second: str, order: str = "rid") -> DataFrame:
    """The first row of each value of one key, then of the other; rows without a key aren't tied by it."""

    def by(d: DataFrame, key: str) -> DataFrame:
        k = F.row_number().over(Window.partitionBy(key).orderBy(order))
        return d.withColumn("_k", k).where(F.col(key).isNull() | (F.col("_k") == 1)).drop("_k")

    return by(by(df, first), second)

"""Land cover, soil, terrain and vegetation summaries of cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .background import running_sum

# Bits of the exclusion mask, lowest first, and its nodata value.
MASK_BITS = (("ocean", 1), ("inland_water", 2), ("snow_ice", 4), ("built_up", 8), ("closed_forest", 16), ("cropland", 32))
MASK_NODATA, HARD_BITS, UNKNOWN_MASK = 255, 15, 15


def class_fractions(pixels: DataFrame, fractions: dict[str, Sequence[int]], keys: Sequence[str] = ("grid_row", "grid_col"), code: str = "code") -> DataFrame:
    """Share of pixels in each set of classes by cell; class 0 is no data."""
    known = F.when(F.col(code) != 0, F.col(code))
    return pixels.groupBy(*keys).agg(*[F.avg(F.when(known.isNotNull(), F.when(known.isin(*c), 1.0).otherwise(0.0))).alias(n) for n, c in fractions.items()], F.count(known).alias("n_pixels"))


def merge_partial(parts: DataFrame, keys: Sequence[str], total: str = "total", n: str = "n", out: str = "value") -> DataFrame:
    """Means from partial sums and counts."""
    return parts.groupBy(*keys).agg(F.try_divide(F.sum(total), F.sum(n)).alias(out))


def fill_unmapped(cells: DataFrame, full: DataFrame, keys: Sequence[str], whole_run: bool = True) -> DataFrame:
    """On a whole run, cells without data are water and excluded; on a partial run they stay unknown."""
    j = full.join(cells, list(keys), "left")
    if not whole_run:
        return j
    unmapped = F.col("n_pixels").isNull() | (F.col("n_pixels") == 0)
    return j.withColumns({"water": F.when(unmapped, 1.0).otherwise(F.col("water")), "exclusion": F.when(unmapped, 1.0).otherwise(F.col("exclusion"))})


def area_share(pixels: DataFrame, keys: Sequence[str], classes: Sequence[str], sea: str = "sea") -> DataFrame:
    """Sum of each class over the number of pixels that aren't sea."""
    land = F.sum((F.col(sea) == 0).cast("bigint"))
    return pixels.groupBy(*keys).agg(*[F.try_divide(F.sum(F.when(F.col(sea) == 0, F.col(c))), land).alias(c) for c in classes])


def majority(columns: Sequence[str], codes: Sequence[int]) -> tuple[Column, Column]:
    """The class of the largest share, the first of equals, and that share."""
    a = F.array(*map(F.col, columns))
    top = F.array_max(a)
    return F.when(top.isNotNull(), F.element_at(F.array(*map(F.lit, codes)), F.array_position(a, top).cast("int"))), top


def exclusion_mask(tests: dict[str, Column], known: Column) -> Column:
    """Bits of the tests that hold, 255 where nothing is known."""
    bits = dict(MASK_BITS)
    out = F.lit(0)
    for name, test in tests.items():
        out = out + F.when(test, bits[name]).otherwise(0)
    return F.when(known, out).otherwise(F.lit(MASK_NODATA))


def effective_mask(mask: Column) -> Column:
    """Unknown counts as excluded."""
    return F.when(mask.isNull() | (mask == MASK_NODATA), UNKNOWN_MASK).otherwise(mask)


def apply_exclusions(score: Column, mask: Column, hard: int = HARD_BITS) -> Column:
    return F.when(effective_mask(mask).bitwiseAND(F.lit(hard)) == 0, score)


def mask_findings(mask: Column, hard: int = HARD_BITS) -> Column:
    """Names of the hard and of the advisory bits."""
    m = effective_mask(mask)
    names = lambda want: F.filter(F.array(*[F.when((m.bitwiseAND(F.lit(b)) != 0), F.lit(n)) for n, b in MASK_BITS if bool(b & hard) == want]), lambda x: x.isNotNull())
    return F.struct(names(True).alias("hard"), names(False).alias("advisory"))


def ndvi_summary(slots: DataFrame, least: int = 8) -> DataFrame:
    """From (cell_id, slot, value): the climatology by slot, then mean, largest, mean of the 12 largest, and range; null under ``least`` slots."""
    clim = slots.where("value is not null").groupBy("cell_id", "slot").agg(F.avg("value").alias("v"))
    a = clim.groupBy("cell_id").agg(F.array_sort(F.collect_list("v"), lambda x, y: F.when(x > y, -1).when(x < y, 1).otherwise(0)).alias("a"))  # 24 slots at most
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda x, y: x + y)
    top = F.slice("a", 1, 12)
    ok = F.size("a") >= least
    return a.select("cell_id", F.size("a").alias("n_slots"), F.when(ok, total(F.col("a")) / F.size("a")).alias("mean"), F.when(ok, F.get("a", 0)).alias("most"), F.when(ok, total(top) / F.size(top)).alias("mean_top12"), F.when(ok, F.array_max("a") - F.array_min("a")).alias("range"))


def moisture_summary(obs: DataFrame) -> DataFrame:
    """Monthly means, then their mean, amplitude and number."""
    m = obs.where("value is not null").groupBy("cell_id", "month").agg(F.avg("value").alias("v"))
    return m.groupBy("cell_id").agg(F.avg("v").alias("mean"), (F.max("v") - F.min("v")).alias("amplitude"), F.count("*").alias("n_months"))


def depth_mean(df: DataFrame, keys: Sequence[str], value: str = "value", thickness: str = "thickness") -> DataFrame:
    """Thickness-weighted mean over the layers that have a value."""
    return df.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * F.col(thickness)), F.sum(F.when(F.col(value).isNotNull(), F.col(thickness)))).alias(value))


def drainage(sand: Column, clay: Column) -> Column:
    from ..functions.scalar import clip

    return 1 + 6 * clip((sand - clay + 100) / 200, 0.0, 1.0)


def texture_closes(sand: Column, silt: Column, clay: Column, within: float = 5.0) -> Column:
    return F.abs(sand + silt + clay - 100) <= within


def terrain(pixels: DataFrame, keys: Sequence[str], z: str = "z", slope: str = "slope", aspect: str = "aspect") -> DataFrame:
    """Height, slope and slope-weighted aspect of cells from finer pixels."""
    n, e = F.cos(F.radians(aspect)), F.sin(F.radians(aspect))
    a = pixels.groupBy(*keys).agg(
        F.avg(z).alias("mean"), F.min(z).alias("least"), F.max(z).alias("most"),
        F.sqrt(F.greatest(F.avg(F.col(z) * F.col(z)) - F.avg(z) * F.avg(z), F.lit(0.0))).alias("sd"),
        F.percentile(slope, F.lit(0.75)).alias("slope_q3"), F.max(slope).alias("slope_max"),
        F.try_divide(F.sum(n * F.col(slope)), F.sum(slope)).alias("northness"), F.try_divide(F.sum(e * F.col(slope)), F.sum(slope)).alias("eastness"),
    )
    return a.withColumns({"range": F.col("most") - F.col("least"), "strength": F.hypot("northness", "eastness")})


def horn(cells: DataFrame, z: str, cell_m: float, lat_of: Column) -> DataFrame:
    """Slope and aspect in degrees by Horn's 3 by 3 window, cell widths by latitude; null at borders and gaps.

    The eight neighbours come from one explode of offsets and one aggregate by cell.
    """
    offs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = cells.where(F.col(z).isNotNull()).select("grid_row", "grid_col", F.col(z).alias("_z"), F.inline(offs))
    spread = spread.select((F.col("grid_row") - F.col("i")).alias("grid_row"), (F.col("grid_col") - F.col("j")).alias("grid_col"), "i", "j", "_z")
    wj, wi = F.when(F.col("i") == 0, 2).otherwise(1) * F.col("j"), F.when(F.col("j") == 0, 2).otherwise(1) * F.col("i")
    g = spread.groupBy("grid_row", "grid_col").agg(F.count("*").alias("_n"), F.max(F.when((F.col("i") == 0) & (F.col("j") == 0), 1)).alias("_own"), F.sum(F.col("_z") * wj).alias("_x"), F.sum(F.col("_z") * wi).alias("_y"))
    g = g.where("_own = 1")
    dx, dy = F.col("_x") / (8 * cell_m * F.cos(F.radians(lat_of))), F.col("_y") / (8 * cell_m)
    ok = F.col("_n") == 9
    return g.select("grid_row", "grid_col", F.when(ok, F.degrees(F.atan(F.hypot(dx, dy)))).alias("slope"), F.when(ok, F.pmod(F.degrees(F.atan2(-dx, dy)) + 360.0, F.lit(360.0))).alias("aspect"))


def box_smooth(cells: DataFrame, value: str, half_rows: int, half_cols: int, height: int, width: int, passes: int = 3) -> DataFrame:
    """Passes of running means down the columns, then along the rows, edge values repeated outside. cells has every (row, col) of the grid.

    Each pass is a window over one row or column of the grid, bounded by the grid's side.
    """

    def along(df: DataFrame, part: str, order: str, half: int, n: int) -> DataFrame:
        if half < 1:
            return df
        w = Window.partitionBy(part).orderBy(order)
        near, whole = w.rowsBetween(-half, half), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        lost_a, lost_b = F.greatest(half - F.col(order), F.lit(0)), F.greatest(half - (n - 1 - F.col(order)), F.lit(0))
        total = F.sum(value).over(near) + F.first(value).over(whole) * lost_a + F.last(value).over(whole) * lost_b
        return df.withColumn(value, total / (2 * half + 1))

    out = cells.withColumn(value, F.col(value).cast("double"))
    for _ in range(passes):
        out = along(along(out, "grid_col", "grid_row", half_rows, height), "grid_row", "grid_col", half_cols, width)
    return out


def half_widths(km: float, cell_deg: float, mid_lat: float, passes: int = 3) -> tuple[int, int]:
    """Half widths in rows and columns of box passes that stand for a Gaussian of this size."""
    from math import cos, radians, sqrt

    half = lambda sigma: max(0, round((sqrt(12 * sigma**2 / passes + 1) - 1) / 2))
    return half(km / (111.32 * cell_deg)), half(km / (111.32 * max(cos(radians(mid_lat)), 0.1) * cell_deg))


def concentration(effort: DataFrame, column: str = "effort") -> DataFrame:
    """One row: share of the total in the top hundredth of the cells, and share of cells with nothing."""
    v = effort.groupBy(column).agg(F.count("*").alias("c"))
    n = v.agg(F.sum("c")).first()[0] or 0
    v = running_sum(v, "c", column)  # no window over all values
    upto, k = n - F.col("_upto") + F.col("c"), F.lit(max(n // 100, 1))
    used = F.greatest(F.least(F.col("c"), k - (upto - F.col("c"))), F.lit(0))
    v = v.withColumn("_top", used * F.col(column))
    return v.agg(F.try_divide(F.sum("_top"), F.sum(F.col("c") * F.col(column))).alias("top_share"), F.try_divide(F.sum(F.when(F.col(column) == 0, F.col("c")).otherwise(0)), F.sum("c")).alias("zero_share"))


def smoothing_ladder(cells: DataFrame, value: str, sizes: Sequence[tuple[int, int]], height: int, width: int, most_zero: float = 0.25) -> tuple[int, int]:
    """The first half widths whose smoothed field is zero in at most this share of cells, else the last."""
    for hr, hc in sizes:
        zero = box_smooth(cells, value, hr, hc, height, width).agg(F.avg((F.col(value) <= 0).cast("double"))).first()[0]
        if zero <= most_zero:
            return hr, hc
    return sizes[-1]


def ranges(df: DataFrame, expected: dict[str, tuple[float, float]]) -> DataFrame:
    """A row for each layer: coverage, extremes, mean, median, share within its expected range, and whether all is."""
    long = df.select(F.stack(F.lit(len(expected)), *[x for c in expected for x in (F.lit(c), F.col(c))]).alias("layer", "v"))
    lo = F.element_at(F.create_map(*[F.lit(x) for c, (a, _) in expected.items() for x in (c, float(a))]), F.col("layer"))
    hi = F.element_at(F.create_map(*[F.lit(x) for c, (_, b) in expected.items() for x in (c, float(b))]), F.col("layer"))
    a = long.groupBy("layer").agg(F.count("v").alias("n"), F.avg(F.col("v").isNotNull().cast("double")).alias("coverage"), F.min("v").alias("least"), F.max("v").alias("most"), F.avg("v").alias("mean"), F.median("v").alias("median"), F.avg(F.col("v").between(lo, hi).cast("double")).alias("within"))
    return a.withColumn("ok", F.col("within") == 1)


def paired_bias(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, zero_is_null: bool = True) -> DataFrame:
    """One row: mean and largest difference of two sources over cells valid in both; zero is sea in the second."""
    left = a.groupBy(*keys).agg(F.avg(value).alias("_a"))
    right = b.groupBy(*keys).agg(F.avg(F.when(F.col(value) != 0, F.col(value)) if zero_is_null else F.col(value)).alias("_b"))
    return left.join(right, list(keys)).where("_a is not null and _b is not null").agg(F.avg(F.col("_b") - F.col("_a")).alias("mean_diff"), F.max(F.abs(F.col("_b") - F.col("_a"))).alias("most_diff"), F.count("*").alias("n"))

"""Climatologies, bioclimatic variables, evaporation and climate change factors."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clip

# Month lengths, mid-month days, and the constants of the FAO-56 equations.
DAYS = (31, 28.25, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
MID_DAY = (15, 45, 74, 105, 135, 166, 196, 227, 258, 288, 319, 349)
SOLAR_CONSTANT, ALBEDO, STEFAN_BOLTZMANN, LATENT_HEAT = 0.0820, 0.23, 4.903e-9, 2.45
#: Variables whose change is a ratio.
RATIO_BIO = (12, 13, 14, 16, 17, 18, 19)


def climatology(monthly: DataFrame) -> DataFrame:
    """Mean over years of (cell_id, var, month), nulls left out; partial averages before the shuffle."""
    return monthly.groupBy("cell_id", "var", "month").agg(F.avg("value").alias("value"))


def month_arrays(clim: DataFrame, variables: Sequence[str] = ("tmin", "tmax", "prec")) -> DataFrame:
    """A row for each cell with an array of twelve months for each variable; months without a value are null."""
    value = lambda v, m: F.max(F.when((F.col("var") == v) & (F.col("month") == m), F.col("value")))
    return clim.groupBy("cell_id").agg(*[F.array(*[value(v, m) for m in range(1, 13)]).alias(v) for v in variables])


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def _sd(a: Column) -> Column:
    """Sample deviation of twelve values."""
    mean = _sum(a) / 12
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda x, y: x + (y - mean) * (y - mean)) / 11)


def quarters(a: Column) -> Column:
    """Sums of three months from each month on, December going on with January."""
    at = lambda i, k: F.get(a, (i + k) % 12)
    return F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: at(i, 0) + at(i, 1) + at(i, 2))


def _at_first(values: Column, by: Column, extreme: Column) -> Column:
    return F.get(values, (F.array_position(by, extreme) - 1).cast("int"))


def bioclim(df: DataFrame, tmin: str = "tmin", tmax: str = "tmax", prec: str = "prec") -> DataFrame:
    """bio_1 to bio_19 from twelve-month arrays; all null where any of the 36 values is."""
    whole = F.forall(F.concat(tmin, tmax, prec), lambda x: x.isNotNull()) & (F.size(F.concat(tmin, tmax, prec)) == 36)
    d = df.withColumns({"_tavg": F.zip_with(tmin, tmax, lambda a, b: (a + b) / 2), "_range": F.zip_with(tmax, tmin, lambda a, b: a - b)})
    d = d.withColumns({"_pq": quarters(F.col(prec)), "_tq": F.transform(quarters(F.col("_tavg")), lambda x: x / 3)})
    d = d.withColumns({"_wet": F.array_max("_pq"), "_dry": F.array_min("_pq"), "_warm": F.array_max("_tq"), "_cold": F.array_min("_tq")})
    tq, pq = F.col("_tq"), F.col("_pq")
    p = F.col(prec)
    b = {
        1: _sum(F.col("_tavg")) / 12,
        2: _sum(F.col("_range")) / 12,
        4: _sd(F.col("_tavg")) * 100,
        5: F.array_max(tmax),
        6: F.array_min(tmin),
        8: _at_first(tq, pq, F.col("_wet")),
        9: _at_first(tq, pq, F.col("_dry")),
        10: F.col("_warm"),
        11: F.col("_cold"),
        12: _sum(p),
        13: F.array_max(p),
        14: F.array_min(p),
        15: _sd(p) * 100 / (1 + _sum(p) / 12),
        16: F.col("_wet"),
        17: F.col("_dry"),
        18: _at_first(pq, tq, F.col("_warm")),
        19: _at_first(pq, tq, F.col("_cold")),
    }
    d = d.withColumns({f"bio_{k}": F.when(whole, v) for k, v in b.items()})
    d = d.withColumn("bio_7", F.col("bio_5") - F.col("bio_6"))
    d = d.withColumn("bio_3", F.try_divide(100 * F.col("bio_2"), "bio_7"))
    return d.select(*df.columns, *[f"bio_{k}" for k in range(1, 20)])


def anomaly(k: int, recent: Column, base: Column, future: Column) -> Column:
    """recent moved by the change from base to future: as a ratio (base at least 1 mm, ratio 0.05 to 20, result not negative) or a difference; null if any is null."""
    if k in RATIO_BIO:
        out = F.greatest(recent * clip(future / F.greatest(base, F.lit(1.0)), 0.05, 20.0), F.lit(0.0))
    else:
        out = recent + (future - base)
    return F.when(recent.isNotNull() & base.isNotNull() & future.isNotNull(), out)


def downscale_prec(fine: Column, coarse: Column, coarse_new: Column, floor: float = 1.0, limits: tuple[float, float] = (0.2, 5.0)) -> Column:
    """Monthly precipitation moved by a coarse change: a clamped ratio, a difference where the coarse month is under the floor."""
    ratio = clip(coarse_new / F.greatest(coarse, F.lit(floor)), *limits)
    out = F.when(coarse < floor, F.greatest(fine + (coarse_new - coarse), F.lit(0.0))).otherwise(fine * ratio)
    return F.when(fine.isNotNull() & coarse.isNotNull() & coarse_new.isNotNull(), out)


def radiation(lat: Column, month: int) -> Column:
    """Extraterrestrial radiation in MJ a square metre and day (FAO-56 equation 21)."""
    day = MID_DAY[month - 1]
    dr, decl = 1 + 0.033 * math.cos(2 * math.pi * day / 365), 0.409 * math.sin(2 * math.pi * day / 365 - 1.39)
    phi = F.radians(lat)
    sunset = F.acos(clip(-F.tan(phi) * math.tan(decl), -1.0, 1.0))
    return F.lit(24 * 60 / math.pi * SOLAR_CONSTANT * dr) * (sunset * F.sin(phi) * math.sin(decl) + F.cos(phi) * math.cos(decl) * F.sin(sunset))


def vapour_pressure(t: Column) -> Column:
    """Saturation vapour pressure in kPa (equation 11)."""
    return F.lit(0.6108) * F.exp(17.27 * t / (t + 237.3))


def hargreaves(tmin: Column, tmax: Column, lat: Column, month: int) -> Column:
    """Monthly evaporation in mm (equation 52)."""
    span = F.when(tmin.isNotNull() & tmax.isNotNull(), F.greatest(tmax - tmin, F.lit(0.0)))
    daily = 0.0023 * radiation(lat, month) / LATENT_HEAT * ((tmin + tmax) / 2 + 17.8) * F.sqrt(span)
    return F.when(daily.isNotNull(), F.greatest(daily, F.lit(0.0)) * DAYS[month - 1])


def penman(tmin: Column, tmax: Column, srad: Column, wind: Column, vapr: Column, elevation: Column, lat: Column, month: int) -> Column:
    """Monthly reference evaporation in mm (equation 6), without soil heat flux."""
    tmean = (tmin + tmax) / 2
    es = (vapour_pressure(tmax) + vapour_pressure(tmin)) / 2
    ea = F.least(vapr, es)
    slope = 4098 * vapour_pressure(tmean) / F.pow(tmean + 237.3, F.lit(2.0))
    gamma = 0.665e-3 * 101.3 * F.pow((293 - 0.0065 * elevation) / 293, F.lit(5.26))
    rso = (0.75 + 2e-5 * elevation) * radiation(lat, month)
    cloud = clip(1.35 * srad / F.greatest(rso, F.lit(1e-6)) - 0.35, 0.05, 1.0)
    rnl = STEFAN_BOLTZMANN * (F.pow(tmax + 273.16, F.lit(4.0)) + F.pow(tmin + 273.16, F.lit(4.0))) / 2 * (0.34 - 0.14 * F.sqrt(F.greatest(ea, F.lit(0.0)))) * cloud
    top = 0.408 * slope * ((1 - ALBEDO) * srad - rnl) + gamma * 900 / (tmean + 273) * wind * F.greatest(es - ea, F.lit(0.0))
    daily = top / (slope + gamma * (1 + 0.34 * wind))
    known = daily.isNotNull() & vapr.isNotNull() & elevation.isNotNull()
    return F.when(known, F.greatest(daily, F.lit(0.0)) * DAYS[month - 1])


def aridity(prec: Column, pet: Column) -> Column:
    return F.when(pet.isNotNull(), prec / F.greatest(pet, F.lit(1e-6)))


def water_deficit(prec: Column, pet: Column) -> Column:
    """Sum over months of what evaporation exceeds precipitation by, of two arrays."""
    return F.aggregate(F.zip_with(pet, prec, lambda e, p: F.greatest(e - p, F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)


def compare_windows(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Over rows valid in all windows, in each group of by: mean, population deviation, median, 5th and 95th percentile of each window, its mean shift from the first, and how often it lies above it at all and by more than 1."""
    whole = df.dropna(subset=list(columns))
    long = whole.select(*by, F.col(columns[0]).alias("_f"), F.stack(F.lit(len(columns)), *[x for c in columns for x in (F.lit(c), F.col(c))]).alias("window", "v"))
    return long.groupBy(*by, "window").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.median("v").alias("median"), F.percentile("v", F.lit(0.05)).alias("p05"), F.percentile("v", F.lit(0.95)).alias("p95"), F.avg(F.col("v") - F.col("_f")).alias("shift"), F.avg((F.col("v") > F.col("_f")).cast("double")).alias("share_over_0"), F.avg((F.col("v") - F.col("_f") > 1).cast("double")).alias("share_over_1"))


def period(year: Column, edges: Sequence[int]) -> Column:
    """The period of a record's year: before the first edge, from each edge to the next, from the last on, or no year."""
    name = F.when(year.isNull(), "no year").when(year < edges[0], f"before {edges[0]}")
    for a, b in zip(edges, edges[1:]):
        name = name.when(year < b, f"{a} to {b - 1}")
    return name.otherwise(f"from {edges[-1]}")


def coverage_loss(cells: DataFrame, old: str, new: str, key: str, top: int = 10) -> DataFrame:
    """Where switching from one source to another loses cells: counts by key, the worst first."""
    lost = F.sum((F.col(old).isNotNull() & F.col(new).isNull()).cast("bigint"))
    a = cells.groupBy(key).agg(F.count(old).alias("n_old"), lost.alias("n_lost"))
    return a.where("n_lost > 0").orderBy(F.col("n_lost").desc(), key).limit(top)

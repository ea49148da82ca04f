"""Scalar functions as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: km of a degree of longitude at the equator and of a degree of latitude
KM_LON, KM_LAT = 111.320, 110.574
# The sixteen directions in words.
COMPASS = (
    "north", "north-north-east", "north-east", "east-north-east", "east", "east-south-east", "south-east", "south-south-east",
    "south", "south-south-west", "south-west", "west-south-west", "west", "west-north-west", "north-west", "north-north-west",
)


def clip(c: Column, low: float, high: float) -> Column:
    """Null stays null: greatest and least alone would skip it."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def null_bad(c: Column, nodata: float | None = None, limit: float = 1e30, both_signs: bool = True) -> Column:
    """Missing values of rasters as null: NaN, the nodata value and values beyond the limit (on request only far negative ones)."""
    bad = F.isnan(c) | (F.abs(c) > limit if both_signs else c < -limit)
    return F.when(~(bad if nodata is None else bad | (c == nodata)), c)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(clip(h, 0.0, 1.0)))


def flat_offsets_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> tuple[Column, Column]:
    """East and north offsets of point 2 from point 1 on a flat earth, at the mean latitude."""
    return (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2)) * F.lit(KM_LON), (lat2 - lat1) * F.lit(KM_LAT)


def flat_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.hypot(*flat_offsets_km(lat1, lon1, lat2, lon2))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees from north; both axes in degrees, the eastern one narrowed by the mean latitude."""
    east = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.pmod(F.degrees(F.atan2(east, lat2 - lat1)) + 360.0, F.lit(360.0))


def compass(degrees: Column) -> Column:
    k = F.floor(F.pmod(degrees, F.lit(360.0)) / 22.5 + 0.5).cast("int")
    return F.element_at(F.array(*map(F.lit, COMPASS)), (F.pmod(k, F.lit(16)) + 1).cast("int"))


def distance_phrase(km: Column, degrees: Column) -> Column:
    return F.when(km < 1.5, F.concat(F.lit("under 2 km "), compass(degrees))).otherwise(F.concat(F.lit("about "), F.bround(km).cast("int").cast("string"), F.lit(" km "), compass(degrees)))


def decimals(c: Column, most: int = 6) -> Column:
    """Decimals that a coordinate needs, 0 to most."""
    n = F.rint(F.abs(c) * F.lit(10.0**most)).cast("bigint")
    out = F.lit(most)
    for k in range(most - 1, -1, -1):
        out = F.when(n % (10 ** (most - k)) == 0, F.lit(k)).otherwise(out)
    return F.when(c.isNotNull(), out)


def slug(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"[^\p{L}\p{N}]", "_"), F.lit("_"))


def as_fraction(v: Column) -> Column:
    return F.when(v > 1.5, v / 100.0).otherwise(v)


def circular(degrees: Column) -> tuple[Column, Column]:
    return F.cos(F.radians(degrees)), F.sin(F.radians(degrees))


def circular_mean(east: Column, north: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def bio_number(name: Column) -> Column:
    return F.regexp_extract(name, r"(?i)bio_(\d+)\.tif$", 1).try_cast("int")


def layer_label(filename: Column) -> Column:
    """A file name as words: no ending, no resolution, blanks for underscores."""
    base = F.regexp_replace(F.regexp_replace(filename, r"^.*/", ""), r"(?i)\.tif$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(base, r"(?i)_?(30s|10m)$", ""), "_+", " "))


def tile_corner(tile: Column) -> tuple[Column, Column]:
    """South and west edges from a tile name such as N45W120."""
    signed = lambda i, minus: F.regexp_extract(tile, r"([NS])(\d{2})([EW])(\d{3})", i + 1).try_cast("int") * F.when(F.regexp_extract(tile, r"([NS])(\d{2})([EW])(\d{3})", i) == minus, -1).otherwise(1)
    return signed(1, "S"), signed(3, "W")


def decade_block(year: Column, first: int = 1960, size: int = 10) -> Column:
    start = F.floor((year - first) / size).cast("int") * size + first
    return F.concat(start.cast("string"), F.lit("-"), (start + size - 1).cast("string"))


def equal_area_x(lat_mean: Column, lon: Column) -> Column:
    return lon * F.cos(F.radians(lat_mean))


def weighted_key(u: Column, w: Column) -> Column:
    """Exponential race: the n smallest keys are a weighted sample without replacement; no weight, no key."""
    return F.when(w > 0, -F.ln(u) / w)


def hashed_uniform(c: Column) -> Column:
    """A number in (0, 1) from an integer key, the same in every engine: the first 52 bits of the MD5 of its decimal text, and a half. Keys follow no pattern and seldom share a number; null: null."""
    return (F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def hashed_uniform_sql(column: str) -> str:
    """The same number in SQL."""
    return f"((('0x' || substr(md5(cast({column} as varchar)), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double)"


def json_number(c: Column) -> Column:
    """NaN and infinities as null, the rest to six places, halves to even."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(math.inf)), F.bround(c, 6))


def any_null(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def missing_share(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in columns]) / F.lit(float(len(columns)))


def ramp(v: Column, low: tuple[int, int, int], high: tuple[int, int, int]) -> Column:
    """Colour between two at v in 0 to 1, as red, green, blue."""
    at = clip(v, 0.0, 1.0)
    return F.struct(*[F.floor(F.lit(float(a)) + at * F.lit(float(b - a)) + 0.5).cast("int").alias(n) for n, a, b in zip("rgb", low, high)])


def diverging(v: Column, most: float, low: tuple[int, int, int], middle: tuple[int, int, int], high: tuple[int, int, int]) -> Column:
    at = clip(v, -most, most) / F.lit(most)
    return F.when(at < 0, ramp(-at, middle, low)).otherwise(ramp(at, middle, high))

"""Cleaning of occurrence records: independent tests on the whole frame, each row charged to the first test that hits it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import decimals, haversine_km
from ..sources.work import staged
from .prefix import group_medians

SCHEMA = ("species", "latitude", "longitude", "year", "country", "basis")


def bad_coordinate() -> Column:
    return F.col("latitude").isNull() | F.col("longitude").isNull()


def null_island(within: float = 0.01) -> Column:
    return F.coalesce((F.abs("latitude") < within) & (F.abs("longitude") < within), F.lit(False))


def lat_equals_lon(within: float = 0.01) -> Column:
    """Equal magnitudes up to an absolute 1e-6 and a relative 1e-5."""
    a, b = F.abs("latitude"), F.abs("longitude")
    return F.coalesce((F.abs(a - b) <= F.lit(1e-6) + F.lit(1e-5) * b) & (a > within), F.lit(False))


def outside(bbox: tuple[float, float, float, float], pad: float = 0.5) -> Column:
    west, south, east, north = bbox
    return F.coalesce(~(F.col("latitude").between(south - pad, north + pad) & F.col("longitude").between(west - pad, east + pad)), F.lit(False))


def whole_degree() -> Column:
    return F.coalesce((F.col("latitude") % 1 == 0) & (F.col("longitude") % 1 == 0), F.lit(False))


def usable_uncertainty(c: str = "uncertainty", most: float = 10_000.0) -> Column:
    return F.col(c).isNull() | (F.col(c) <= most)


def select_occurrences(df: DataFrame, countries: Sequence[str] | None = None, bbox: tuple[float, float, float, float] | None = None, least: int = 0) -> DataFrame:
    """Rows with finite coordinates in the countries (case and blanks aside) and the box (edges included), of species that keep at least ``least`` of them."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    out = df.where(finite("latitude") & finite("longitude"))
    if countries is not None:
        out = out.where(F.upper(F.trim("country")).isin(*[c.strip().upper() for c in countries]))
    if bbox is not None:
        out = out.where(~outside(bbox, 0.0))
    if least > 1:
        out = out.join(out.groupBy("species").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("species"), "species", "left_semi")
    return out


def tree_binomial(name: Column, genera: Sequence[str]) -> Column:
    """Two words at least, the genus known, the epithet none of the placeholders."""
    part = F.split(F.trim(name), r"\s+")
    epithet = F.lower(F.regexp_replace(F.get(part, 1), r"\.$", ""))
    return F.coalesce((F.size(part) >= 2) & F.get(part, 0).isin(*genera) & ~epithet.isin("sect", "sp", "spp", "x"), F.lit(False))


def duplicates(df: DataFrame, keys: Sequence[str] = ("species", "latitude", "longitude"), order: str = "rid", out: str = "is_duplicate") -> DataFrame:
    """Every row after the first of its keys in input order. Rows that lack a coordinate are told by another test and are no duplicates, so they don't meet in one window."""
    alone = F.when(bad_coordinate(), F.col(order))
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys, alone).orderBy(order)) > 1)


def not_listed(df: DataFrame, species: DataFrame, out: str = "not_listed") -> DataFrame:
    listed = species.select("species").where("species is not null").distinct().withColumn("_listed", F.lit(True))
    return df.join(listed, "species", "left").withColumn(out, F.col("_listed").isNull()).drop("_listed")


def non_plants(df: DataFrame, taxonomy: DataFrame, out: str = "non_plant") -> DataFrame:
    """Known not to be a vascular plant; unknown names are kept."""
    tax = taxonomy.select("species", F.col("kingdom").alias("_kingdom"), F.col("phylum").alias("_phylum"))
    known = F.col("_kingdom").isNotNull()
    return df.join(tax, "species", "left").withColumn(out, F.coalesce(known & ~((F.col("_kingdom") == "Plantae") & F.coalesce(F.col("_phylum") == "Tracheophyta", F.lit(False))), F.lit(False))).drop("_kingdom", "_phylum")


def magnets(df: DataFrame, least_records: int = 25, least_species: int = 8, sure_species: int = 30, out: str = "magnet") -> DataFrame:
    """Coordinates (5 places, halves to even) that draw many species and look like centroids or draw very many."""
    keyed = df.withColumns({"_la": F.bround("latitude", 5), "_lo": F.bround("longitude", 5)})
    # few groups pass: the join's right side is small
    groups = keyed.where(~bad_coordinate()).groupBy("_la", "_lo").agg(F.count("*").alias("_n"), F.countDistinct("species").alias("_s")).where((F.col("_n") >= least_records) & (F.col("_s") >= least_species))
    hit = F.col("_s").isNotNull() & ((F.col("_s") >= sure_species) | ((decimals(F.col("latitude")) <= 2) & (decimals(F.col("longitude")) <= 2)))
    return keyed.join(groups, ["_la", "_lo"], "left").withColumn(out, hit).drop("_la", "_lo", "_n", "_s")


def range_outliers(df: DataFrame, least: int = 20, sigmas: float = 8.0, floor_km: float = 3000.0, out: str = "outlier") -> DataFrame:
    """Distance from the species' median point beyond the larger of floor_km and median + sigmas * 1.4826 MAD.

    Medians are exact and found in rounds, without a buffer of a species' values; the three small tables of them (a row for each species) are written, and the rows are joined once. Nulls are left out of
    the medians.
    """
    km = haversine_km(F.col("_cla"), F.col("_clo"), F.col("latitude"), F.col("longitude"))
    centre = staged(group_medians(df.select("species", F.col("latitude").alias("_cla"), F.col("longitude").alias("_clo")), "species", ["_cla", "_clo"]).withColumnRenamed("n", "_n"), "centres")
    far = df.select("species", "latitude", "longitude").join(centre, "species").withColumn("_km", km)
    med = staged(group_medians(far, "species", ["_km"]).drop("n").withColumnRenamed("_km", "_med").join(centre, "species"), "medians")
    dev = df.select("species", "latitude", "longitude").join(med, "species").select("species", F.abs(km - F.col("_med")).alias("_mad"))
    mad = staged(group_medians(dev, "species", ["_mad"]).drop("n").join(med, "species"), "deviations")
    limit = F.greatest(F.col("_med") + F.lit(sigmas * 1.4826) * F.col("_mad"), F.lit(floor_km))
    return df.join(mad, "species", "left").withColumn(out, F.coalesce((F.col("_n") >= least) & (km > limit), F.lit(False))).drop("_cla", "_clo", "_n", "_med", "_mad")


def attribute(df: DataFrame, tests: Sequence[tuple[str, Column]], out: str = "drop_reason") -> DataFrame:
    """The name of the first test that hits, in order; null for clean rows."""
    return df.withColumn(out, F.coalesce(*[F.when(t, F.lit(n)) for n, t in tests]))


def clean(occ: DataFrame, bbox: tuple[float, float, float, float], species: DataFrame | None = None) -> DataFrame:
    """occ with drop_reason: every test sees the full frame."""
    df = magnets(range_outliers(duplicates(occ)))
    tests = [("bad_coordinate", bad_coordinate()), ("duplicate", F.col("is_duplicate")), ("null_island", null_island()), ("lat_equals_lon", lat_equals_lon()), ("outside", outside(bbox)), ("magnet", F.col("magnet")), ("outlier", F.col("outlier"))]
    if species is not None:
        df, tests = not_listed(df, species), [("not_listed", F.col("not_listed")), *tests]
    return attribute(df, tests).drop("is_duplicate", "magnet", "outlier", "not_listed")

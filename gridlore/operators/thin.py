"""Thinning to one record of a species in a cell, and counts of what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import Grid


def on_grid(df: DataFrame, grid: Grid) -> DataFrame:
    return df.withColumns({"grid_row": grid.row(F.col("latitude")), "grid_col": grid.col(F.col("longitude"))})


def thin(df: DataFrame, grid: Grid, newest: bool = True) -> DataFrame:
    """One row of each (species, cell): the newest year (null oldest), ties the earliest input row; with n_records of the cell. Combined before the shuffle."""
    year = F.coalesce("year", F.lit(-1)) if newest else F.lit(0)
    own = F.max_by(F.struct(*df.columns), F.struct(year, -F.col("rid")))
    kept = on_grid(df, grid).groupBy(F.col("species").alias("_s"), "grid_row", "grid_col").agg(own.alias("_own"), F.count("*").alias("n_records"))
    return kept.select("_own.*", "grid_row", "grid_col", "n_records")


def first_per_cell(df: DataFrame, grid: Grid) -> DataFrame:
    """The first row of each cell in input order, only on the grid."""
    placed = on_grid(df, grid).where(grid.inside(F.col("grid_row"), F.col("grid_col")))
    cell = grid.cell_id(F.col("grid_row"), F.col("grid_col"))
    first = placed.groupBy(cell.alias("cell_id")).agg(F.min_by(F.struct(*placed.columns), "rid").alias("_own"))
    return first.select("_own.*", "cell_id")


def in_output_order(thinned: DataFrame) -> DataFrame:
    """The order in which thinned records are written."""
    return thinned.orderBy("species", "grid_row", "grid_col")


def most_recorded(df: DataFrame, most: int) -> DataFrame:
    """The species of most records and their counts, ties by name; most is the caller's cap on a run."""
    return df.groupBy("species").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "species").limit(most)


def cells_per_species(df: DataFrame, gate: int = 0) -> DataFrame:
    """Distinct cells and records of each species with at least ``gate`` cells."""
    return df.groupBy("species").agg(F.countDistinct("grid_row", "grid_col").alias("n_cells"), F.sum("n_records").alias("n_records")).where(F.col("n_cells") >= gate)


def summary(df: DataFrame, top: int = 5) -> DataFrame:
    """One row: records, species, median year, share of the most frequent species in percent."""
    per = df.groupBy("species").agg(F.count("*").alias("n"))
    most = per.orderBy(F.col("n").desc(), "species").limit(top).agg(F.sum("n").alias("top_n"))
    whole = df.agg(F.count("*").alias("n_records"), F.countDistinct("species").alias("n_species"), F.median("year").cast("int").alias("median_year"))
    both = whole.unionByName(most, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ("n_records", "n_species", "median_year", "top_n")])
    return both.select("n_records", "n_species", "median_year", F.round(F.lit(100.0) * F.try_divide("top_n", "n_records"), 4).alias("top_share_pct"))


def count_quantiles(df: DataFrame, key: str = "species") -> DataFrame:
    """Tenth, half, nine tenths and maximum of the counts by key."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    q = F.percentile("n", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return n.agg(q.alias("q"), F.max("n").alias("most")).select(*[F.round(F.col("q")[i], 6).alias(x) for i, x in enumerate(("p10", "p50", "p90"))], "most")


def shares(df: DataFrame, key: str) -> DataFrame:
    """Share of each value among the rows that have one."""
    n = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 8))

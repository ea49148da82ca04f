"""Queries that write cells as raster files and read them back, with their SQL on the cells themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.grid import Grid
from ..sources.ranged import local_path
from ..sources.raster import pack, raster_grid, read_raster, write_raster
from ..sources.tables import view, window
from ..sources.work import work_path

# Customers lie on a grid 40 columns wide, in the order of their keys.
_WIDTH = 40
_CELLS = f"cells as (select cast(c_custkey // {_WIDTH} as int) as grid_row, cast(c_custkey % {_WIDTH} as int) as grid_col, cast(c_acctbal as float) as v, cast(c_nationkey as float) as n, c_mktsegment as s from customer)"
_ALL = "g as (select r.r as grid_row, c.c as grid_col from (select unnest(range(cast((select max(grid_row) + 1 from cells) as bigint))) as r) r, (select unnest(range(40)) as c) c)"


def _cells(s, d):
    i = F.col("c_custkey")
    return view(s, d, "customer").select(F.floor(i / _WIDTH).cast("int").alias("grid_row"), (i % _WIDTH).cast("int").alias("grid_col"), F.col("c_acctbal").cast("double").alias("v"), F.col("c_nationkey").cast("double").alias("n"), F.col("c_mktsegment").alias("s"))


def _grid(cells):
    return Grid("customers", _WIDTH, cells.agg(F.max("grid_row")).first()[0] + 1, -20.0, 0.25, 60.0, -0.25)


def _written(s, cells, bands, **how):
    write_raster(cells, path := f"{local_path(work_path(s, 'raster'))}.tif", _grid(cells), bands, **how)
    return path


def _round_trip(s, d):
    path = _written(s, _cells(s, d), ["v", "n"], block=(16, 16), predictor=3)
    return read_raster(s, path).select("grid_row", "grid_col", F.col("band_1").alias("v"), F.col("band_2").alias("n"))


_ROUND_TRIP_SQL = f"with {_CELLS}, {_ALL} select cast(g.grid_row as int) as grid_row, cast(g.grid_col as int) as grid_col, cast(v as double) as v, cast(n as double) as n from g left join cells using (grid_row, grid_col)"


def _windowed(s, d):
    """The extent as an option chooses blocks; the same extent on the cells gives the same."""
    path = _written(s, _cells(s, d).where("v > 0"), ["v"], block=(8, _WIDTH), tiled=False)
    extent = -18.6, 57.3, -14.1, 59.2
    option, cells = read_raster(s, path, window=extent), window(read_raster(s, path), raster_grid(path), *extent)
    return option.join(cells.withColumnRenamed("band_1", "again"), ["grid_row", "grid_col"]).select("grid_row", "grid_col", F.col("band_1").alias("v"), (F.col("band_1").eqNullSafe(F.col("again"))).alias("same"))


_WINDOW_SQL = f"""with {_CELLS}, {_ALL}
select cast(g.grid_row as int) as grid_row, cast(g.grid_col as int) as grid_col, cast(v as double) as v, true as same
from g left join (select * from cells where v > 0) using (grid_row, grid_col) where g.grid_row between 3 and 10 and g.grid_col between 5 and 23"""


def _archive(s, d):
    """A raster for each segment in one archive, read as a table of members."""
    cells = _cells(s, d)
    tops = [r[0] for r in cells.select("s").distinct().orderBy("s").collect()]  # five segments
    grid, folder, paths = _grid(cells), local_path(work_path(s, "rasters")), []
    for name in tops:
        paths.append(f"{folder}-{name.lower()}.tif")
        write_raster(cells.where(F.col("s") == name), paths[-1], grid, ["v"], block=(32, 32))
    pack(paths, f"{folder}.zip")
    got = read_raster(s, f"{folder}.zip!*.tif").where("band_1 is not null")
    return got.select(F.upper(F.regexp_extract("member", r"([a-z]+)\.tif$", 1)).alias("s"), "grid_row", "grid_col", F.col("band_1").alias("v"))


_ARCHIVE_SQL = f"with {_CELLS} select s, grid_row, grid_col, cast(v as double) as v from cells"

QUERIES = {"raster_round_trip": (_round_trip, _ROUND_TRIP_SQL), "raster_window": (_windowed, _WINDOW_SQL), "raster_archive": (_archive, _ARCHIVE_SQL)}

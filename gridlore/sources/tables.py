"""Reading: explicit schemas, required columns, missing values as null; and the stand-ins for reference inputs over the test tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.grid import Grid
from ..functions.scalar import null_bad

OCCURRENCES = ("species", "latitude", "longitude", "year", "country", "basis")
STATUSES = ("saved", "skip_no_records", "skip_few_cells", "skip_no_background", "skip_train_error", "skip_no_folds", "skip_few_folds", "skip_not_tree")


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def occurrences(spark: SparkSession, path: str) -> DataFrame:
    """Occurrence CSV: read as strings, numbers that don't parse become null; rid keeps the order within the input.

    A header in any case is accepted; a column that is missing stops the read.
    """
    raw = spark.read.csv(path, header=True)
    named = raw.select(*[F.col(f"`{c}`").alias(c.strip().lower()) for c in raw.columns])
    require_columns(named, OCCURRENCES)
    number = lambda c: null_bad(F.expr(f"try_cast({c} AS DOUBLE)"))
    return named.select("species", number("latitude").alias("latitude"), number("longitude").alias("longitude"), F.expr("try_cast(try_cast(year AS DOUBLE) AS INT)").alias("year"), "country", "basis", F.monotonically_increasing_id().alias("rid"))


def species_list(spark: SparkSession, path: str, columns: Sequence[str] = ("species", "common_name", "use", "notes")) -> DataFrame:
    """Species CSV with # comments: trimmed, blanks dropped, the first of equal names kept in file order; empty is an error."""
    raw = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).csv(path, comment="#", header=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    rows = raw.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) for c in columns], F.monotonically_increasing_id().alias("rid")).where("species is not null and lower(species) <> 'species'")
    first = rows.groupBy("species").agg(F.min_by(F.struct(*columns[1:], "rid"), "rid").alias("x")).select("species", *[f"x.{c}" for c in columns[1:]], "x.rid")
    if first.isEmpty():
        raise ValueError("the species list is empty")
    return first.orderBy("rid")


def grid_manifest(spark: SparkSession, path: str, name: str) -> Grid:
    """A grid from its JSON manifest: width, height and transform (a, b, c, d, e, f), or a bounding box."""
    r = spark.read.json(path, multiLine=True).first().asDict(recursive=True)
    w, h = int(r["width"]), int(r["height"])
    if r.get("bbox"):
        b = r["bbox"]
        west, south, east, north = (b[k] for k in ("west", "south", "east", "north")) if isinstance(b, dict) else b
        return Grid(name, w, h, west, (east - west) / w, north, (south - north) / h)
    t = r["transform"]
    return Grid(name, w, h, t[2], t[0], t[5], t[4])


def layer(df: DataFrame, column: str, nodata: float | None = None, both_signs: bool = True) -> DataFrame:
    """A layer's cell table with missing values as null."""
    return df.withColumn(column, null_bad(F.col(column), nodata, both_signs=both_signs))


def window(cells: DataFrame, grid: Grid, west: float, south: float, east: float, north: float) -> DataFrame:
    """Cells of an extent: a range predicate on row and column that reaches the scan."""
    r0, r1, c0, c1 = grid.window(west, south, east, north)
    return cells.where(F.col("grid_row").between(r0, r1) & F.col("grid_col").between(c0, c1))


def pixel(cells: DataFrame, grid: Grid, lat: float, lon: float) -> DataFrame:
    from math import floor

    return cells.where((F.col("grid_row") == floor((lat - grid.f) / grid.e)) & (F.col("grid_col") == floor((lon - grid.c) / grid.a)))


def stack(cells: DataFrame, layers: Sequence[str]) -> DataFrame:
    """Cells with valid: all layers present, in the order of the contract."""
    require_columns(cells, layers)
    valid = F.lit(True)
    for c in layers:
        valid = valid & F.col(c).isNotNull()
    return cells.withColumn("valid", valid)


def saved_models(metrics: DataFrame, artifacts: DataFrame, min_auc: float = 0.7) -> DataFrame:
    """Saved, good enough, and the file is there."""
    return metrics.where((F.col("status") == "saved") & (F.col("auc") >= min_auc)).join(artifacts.select("model_path").distinct(), "model_path", "left_semi")


def discover_runs(runs: DataFrame, preferred: str | None = None) -> DataFrame:
    """Of each country the run of the finest cells: the preferred profile first, then most species, then newest."""
    from pyspark.sql import Window

    order = Window.partitionBy("country").orderBy(F.col("cell_deg").asc(), (F.col("profile") == F.lit(preferred or "")).desc(), F.col("n_species").desc(), F.col("mtime").desc(), F.col("path"))
    return runs.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def common_names(sources: Sequence[DataFrame]) -> DataFrame:
    """Names of several sources in order of precedence (species, common_name, notes): the first label wins, notes gather clause by clause without repeats (case aside)."""
    from functools import reduce

    rows = reduce(DataFrame.unionByName, [s.select("species", "common_name", "notes", F.lit(i).alias("p")) for i, s in enumerate(sources)])
    rows = rows.where("species is not null")
    label = F.min_by(F.nullif(F.trim("common_name"), F.lit("")), F.when(F.length(F.trim("common_name")) > 0, F.col("p")))
    names = rows.groupBy("species").agg(label.alias("common_name"))
    clauses = rows.select("species", "p", F.posexplode(F.split("notes", ";")).alias("k", "c")).withColumn("c", F.trim("c")).where("c <> ''")
    first = clauses.groupBy("species", F.lower("c").alias("l")).agg(F.min(F.struct("p", "k", "c")).alias("x"))
    notes = first.groupBy("species").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["c"]), "; ").alias("notes"))  # clauses of one species
    return names.join(notes, "species", "left")


def parse_manifest(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A JSON column as a struct; what doesn't parse is null."""
    return df.withColumn(column, F.from_json(column, schema))


#: The occurrence stand-in over the events table; the same text runs in Spark SQL and DuckDB.
OCC_SQL = """select event_id as rid, concat('species_', cast(user_id % 12 as string)) as species,
  case when event_id % 97 = 0 then null when event_id % 101 = 0 then cast(0 as double) when event_id % 53 = 0 then cast(30 as double)
       when event_id % 107 = 0 then cast(31 as double) + cast((event_id * 17) % 300 as double) / cast(100 as double)
       when event_id % 131 = 0 then cast(55 as double) + cast((event_id * 7919) % 500 as double) / cast(100 as double)
       when event_id % 89 = 0 then cast(46 as double) + cast((event_id * 37) % 300 as double) / cast(100 as double)
       else cast(30 as double) + cast((event_id * 7919) % 500 as double) / cast(100 as double) end as latitude,
  case when event_id % 97 = 0 then null when event_id % 101 = 0 then cast(0 as double) when event_id % 53 = 0 then cast(-97 as double)
       when event_id % 107 = 0 then cast(-31 as double) - cast((event_id * 17) % 300 as double) / cast(100 as double)
       when event_id % 131 = 0 then cast(-120 as double) + cast((event_id * 104729) % 500 as double) / cast(100 as double)
       when event_id % 89 = 0 then cast(-62 as double) + cast((event_id * 41) % 200 as double) / cast(100 as double)
       else cast(-100 as double) + cast((event_id * 104729 + user_id * 613) % 500 as double) / cast(100 as double) end as longitude,
  case when event_id % 11 = 0 then null else cast(1980 + (event_id * 31) % 45 as int) end as year,
  'US' as country, event_type as basis
from {events}"""

#: Cells of the global grid under the stand-in's occurrences, with made layers; nulls by modulus.
CELLS_SQL = """select c.cell_id, cast((c.cell_id - c.cell_id % 2160) / 2160 as int) as grid_row, cast(c.cell_id % 2160 as int) as grid_col,
  case when c.cell_id % 37 = 0 then null else cast((c.cell_id * 7919) % 400 as double) / cast(10 as double) - cast(5 as double) end as bio_1,
  case when c.cell_id % 41 = 0 then null else cast((c.cell_id * 104729) % 2500 as double) end as bio_12,
  cast((c.cell_id * 31) % 3600 as double) / cast(10 as double) as aspect,
  case when c.cell_id % 43 = 0 then null else cast((c.cell_id * 17) % 101 as double) / cast(100 as double) end as tree,
  cast(case when c.cell_id % 61 = 0 then 255 else c.cell_id % 64 end as int) as mask
from (select distinct cast(floor((latitude - cast(90 as double)) / (cast(-1 as double) / cast(6 as double))) as bigint) * 2160 + cast(floor((longitude + cast(180 as double)) / (cast(1 as double) / cast(6 as double))) as bigint) as cell_id from {occ} where latitude is not null) c"""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def occ(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(OCC_SQL, events=view(spark, sf_dir, "events"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CELLS_SQL, occ=occ(spark, sf_dir))

"""Queries of record filters, layer tables, tiles, checks before a run and training, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, climate, landcover, thin, training
from ..operators import layers as L
from ..sources.tables import CELLS_SQL, OCC_SQL, cells, occ, view
from . import guards

_OCC = f"with occ as ({OCC_SQL.format(events='events')})"
_CELLS = _OCC + f", cells as ({CELLS_SQL.format(occ='occ')})"
_PX = "with px as (select o_orderkey % 40 grid_row, o_custkey % 30 grid_col, cast((o_orderkey * 7 + o_custkey) % 6 as int) code, o_totalprice / 997 z, o_orderkey % 4 part from orders)"
_GRID = "with g as (select cast(c_custkey // 30 as int) grid_row, cast(c_custkey % 30 as int) grid_col, cast(c_acctbal as double) v from customer)"


def _pixels(s, d):
    o = view(s, d, "orders")
    return o.select(
        (F.col("o_orderkey") % 40).alias("grid_row"),
        (F.col("o_custkey") % 30).alias("grid_col"),
        ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % 6).cast("int").alias("code"),
        (F.col("o_totalprice") / 997).alias("z"),
        (F.col("o_orderkey") % 4).alias("part"),
    )


def _grid(s, d):
    i = F.col("c_custkey")
    return view(s, d, "customer").select(F.floor(i / 30).cast("int").alias("grid_row"), (i % 30).cast("int").alias("grid_col"), F.col("c_acctbal").cast("double").alias("v"))


def _filter(s, d):
    country = F.when(F.col("rid") % 3 == 0, " us").when(F.col("rid") % 3 == 1, "US").otherwise("FR")
    return clean.select_occurrences(occ(s, d).withColumn("country", country), ["us "], (-99.0, 30.0, -95.0, 35.0), 20).select("rid", "species")


_FILTER_SQL = _OCC + """,
k as (
  select rid, species from occ
  where rid % 3 < 2 and latitude between 30 and 35 and longitude between -99 and -95)
select rid, species from k where species in (select species from k group by 1 having count(*) >= 20)"""


def _gate(s, d):
    return cells(s, d).select("cell_id", guards.layer_gate(["bio_1"], ["bio_1", "bio_12", "tree"], 1).alias("problem"))


_GATE_SQL = _CELLS + """
select cell_id,
  case when bio_1 is null then 'needed layer missing'
       when cast(bio_12 is null as int) + cast(tree is null as int) > 1 then 'too many layers missing' end as problem
from cells"""


def _long(df):
    pairs = [x for c in ("bio_1", "bio_12", "tree") for x in (F.lit(c), F.col(c))]
    return df.select("cell_id", F.stack(F.lit(3), *pairs).alias("layer", "value"))


def _scaled(s, d):
    scales = s.createDataFrame([("bio_1", 10.0), ("tree", 0.0)], "layer string, divisor double")
    return L.scaled(_long(cells(s, d)), scales).select("cell_id", "layer", F.round("value", 8).alias("value"))


_SCALED_SQL = _CELLS + """
select cell_id, 'bio_1' as layer, round(bio_1 / 10, 8) as value from cells
union all select cell_id, 'bio_12', round(bio_12, 8) from cells
union all select cell_id, 'tree', round(tree, 8) from cells"""


def _tiles(s, d):
    t = L.tiles(cells(s, d), 8, 2)
    return t.groupBy("tile_row", "tile_col").agg(F.count_if("own").alias("n_own"), F.count_if(~F.col("own")).alias("n_halo"))


_TILES_SQL = _CELLS + """,
t as (select distinct grid_row // 8 + i tile_row, grid_col // 8 + j tile_col from cells, range(-1, 2) a(i), range(-1, 2) b(j)),
x as (
  select tile_row, tile_col, grid_row // 8 = tile_row and grid_col // 8 = tile_col as own
  from t join cells on grid_row between tile_row * 8 - 2 and tile_row * 8 + 9 and grid_col between tile_col * 8 - 2 and tile_col * 8 + 9
  where tile_row >= 0 and tile_col >= 0)
select cast(tile_row as int) as tile_row, cast(tile_col as int) as tile_col, count(*) filter (own) as n_own, count(*) filter (not own) as n_halo
from x group by 1, 2"""


def _labelled(s, d):
    o = occ(s, d)
    return L.labelled(o.where("species = 'species_1'").select("rid", "species"), o.where("species <> 'species_1'").select("rid", "basis"))


def _layer_union(s, d):
    own = _long(cells(s, d)).groupBy("layer").agg(F.round(F.avg("value"), 6).alias("value"))
    return L.layer_union(own.where("layer <> 'tree'"), own.where("layer <> 'bio_1'").withColumn("value", F.round(F.col("value") * 2, 5)))


_LAYER_UNION_SQL = _CELLS + """,
a as (select 'bio_1' as layer, round(avg(bio_1), 6) v from cells union all select 'bio_12', round(avg(bio_12), 6) from cells),
b as (select 'bio_12' as layer, round(round(avg(bio_12), 6) * 2, 5) v from cells union all select 'tree', round(round(avg(tree), 6) * 2, 5) from cells)
select coalesce(a.layer, b.layer) as layer, a.v as value_a, b.v as value_b from a full join b on a.layer = b.layer"""


def _overlay(s, d):
    p = view(s, d, "part").select(F.col("p_partkey").alias("species"), F.col("p_brand").alias("origin"))
    rows = p.select("species", F.lit("unknown").alias("origin")).where("species % 4 <> 0")
    return L.mapped_overlay(rows, p.where("species % 3 = 0"), {"origin": {"brand#13": "native", "brand#25": "introduced"}})


_OVERLAY_SQL = """
select p_partkey as species,
  case when p_partkey % 3 <> 0 then 'unknown' when lower(trim(p_brand)) = 'brand#13' then 'native'
       when lower(trim(p_brand)) = 'brand#25' then 'introduced' else 'unknown' end as origin
from part where p_partkey % 4 <> 0"""


def _tile_means(s, d):
    parts = _pixels(s, d).groupBy("grid_row", "grid_col", "part").agg(F.sum("z").alias("total"), F.count("z").alias("n"))
    return landcover.merge_partial(parts, ["grid_row", "grid_col"]).select("grid_row", "grid_col", F.round("value", 6).alias("value"))


def _unmapped(s, d):
    px = _pixels(s, d)
    known = landcover.class_fractions(px.where("grid_col % 3 > 0"), {"water": [1], "exclusion": [4, 5]})
    return landcover.fill_unmapped(known, px.select("grid_row", "grid_col").distinct(), ["grid_row", "grid_col"]).select("grid_row", "grid_col", F.round("water", 8).alias("water"), F.round("exclusion", 8).alias("exclusion"))


_UNMAPPED_SQL = _PX + """
select grid_row, grid_col,
  round(case when grid_col % 3 = 0 or count(nullif(code, 0)) = 0 then 1.0 else avg(case when code <> 0 then cast(code = 1 as int) end) end, 8) as water,
  round(case when grid_col % 3 = 0 or count(nullif(code, 0)) = 0 then 1.0 else avg(case when code <> 0 then cast(code in (4, 5) as int) end) end, 8) as exclusion
from px group by 1, 2"""


def _area(s, d):
    px = _pixels(s, d).withColumns({"sea": (F.col("code") == 0).cast("int"), "grass": F.col("z") / 500})
    return landcover.area_share(px, ["grid_row", "grid_col"], ["grass"]).select("grid_row", "grid_col", F.round("grass", 8).alias("grass"))


def _slopes(s, d):
    out = L.slope_order(_grid(s, d), "v", 3, 900.0, F.lit(45.0) - F.col("grid_row") / 120, F.lit(45.0) - F.col("grid_row") / 40)
    return out.select("grid_row", "grid_col", *[F.round(c, 5).alias(c) for c in ("mean_slope", "p90_slope", "slope_of_mean", "ratio")])


def _slope_sql(src: str, cell_m: float, deg: float) -> str:
    return f"""(
  select grid_row, grid_col, case when n = 9 then degrees(atan(sqrt(dx * dx + dy * dy))) end as slope
  from (
    select a.grid_row, a.grid_col, count(*) n,
      sum(b.v * j * (case when i = 0 then 2 else 1 end)) / (8 * {cell_m} * cos(radians(45.0 - a.grid_row / {deg}))) dx,
      sum(b.v * i * (case when j = 0 then 2 else 1 end)) / (8 * {cell_m}) dy
    from {src} a, (values (-1), (0), (1)) i(i), (values (-1), (0), (1)) j(j), {src} b
    where b.grid_row = a.grid_row + i and b.grid_col = a.grid_col + j
    group by 1, 2))"""


_SLOPES_SQL = _GRID + f""",
c as (select grid_row // 3 as grid_row, grid_col // 3 as grid_col, avg(v) v from g group by 1, 2),
n as (
  select grid_row // 3 as grid_row, grid_col // 3 as grid_col, avg(slope) m, quantile_cont(slope, 0.9) p
  from {_slope_sql("g", 900.0, 120.0)} group by 1, 2),
f as (select * from {_slope_sql("c", 2700.0, 40.0)})
select n.grid_row, n.grid_col, round(m, 5) as mean_slope, round(p, 5) as p90_slope, round(f.slope, 5) as slope_of_mean, round(m / nullif(f.slope, 0), 5) as ratio
from n join f on f.grid_row = n.grid_row and f.grid_col = n.grid_col where m is not null and f.slope is not null"""


def _agree(s, d):
    g = _grid(s, d)
    other = g.where("(grid_row + grid_col) % 7 > 0").select("grid_row", "grid_col", (F.col("v") + F.col("grid_row") * 100).alias("published"))
    return L.agreement(g, other, ["grid_row", "grid_col"], "v", "published").select("n", F.round("corr", 8).alias("corr"))


def _periods(s, d):
    o = occ(s, d).where("latitude is not null").select(climate.period(F.col("year"), [1990, 2000, 2010]).alias("period"), F.col("latitude").alias("a"), (F.col("latitude") + F.col("rid") % 5 - 2).alias("b"))
    out = climate.compare_windows(o, ["a", "b"], ["period"])
    return out.select("period", "window", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "median", "shift", "share_over_0", "share_over_1")])


_PERIODS_SQL = _OCC + """,
o as (
  select case when year is null then 'no year' when year < 1990 then 'before 1990' when year < 2000 then '1990 to 1999'
              when year < 2010 then '2000 to 2009' else 'from 2010' end as period,
    latitude a, latitude + rid % 5 - 2 b
  from occ where latitude is not null),
l as (select period, 'a' w, a v, a from o union all select period, 'b', b, a from o)
select period, w as "window", round(avg(v), 6) as mean, round(stddev_pop(v), 6) as sd, round(median(v), 6) as median, round(avg(v - a), 6) as shift,
  round(avg(cast(v > a as int)), 6) as share_over_0, round(avg(cast(v - a > 1 as int)), 6) as share_over_1
from l group by 1, 2"""


def _train(s, d):
    """One model for each of three made species: metrics only, as trees can't be trained in SQL."""
    c = cells(s, d).withColumn("block", F.floor(F.col("cell_id") / 40) % 17)
    y = F.when(F.col("species") == 0, F.col("bio_1") > 15).when(F.col("species") == 1, F.col("bio_12") > 1200).otherwise(F.col("tree") > 2)
    rows = c.withColumn("species", F.explode(F.array(*map(F.lit, range(3))))).withColumn("y", F.coalesce(y, F.lit(False)).cast("int"))
    out = training.train_species(rows, ["bio_1", "bio_12"], s=training.Settings(rounds=60, patience=10))
    return out.select("species", F.round("auc", 4).alias("auc"), "n_trees", "n_usable", "n_folds", "n_rows")


QUERIES = {
    "occurrence_filter": (_filter, _FILTER_SQL),
    "layer_gate": (_gate, _GATE_SQL),
    "layer_scales": (_scaled, _SCALED_SQL),
    "tile_halo": (_tiles, _TILES_SQL),
    "most_recorded": (lambda s, d: thin.most_recorded(occ(s, d), 5), _OCC + " select species, count(*) as n from occ group by 1 order by n desc, species limit 5"),
    "presence_background": (_labelled, _OCC + " select rid, case when species = 'species_1' then species end as species, case when species <> 'species_1' then basis end as basis, cast(species = 'species_1' as int) as y from occ"),
    "layer_union": (_layer_union, _LAYER_UNION_SQL),
    "mapped_overlay": (_overlay, _OVERLAY_SQL),
    "tile_means": (_tile_means, _PX + " select grid_row, grid_col, round(avg(z), 6) as value from px group by 1, 2"),
    "unmapped_fill": (_unmapped, _UNMAPPED_SQL),
    "area_shares": (_area, _PX + " select grid_row, grid_col, round(sum(case when code <> 0 then z / 500 end) / nullif(count(*) filter (code <> 0), 0), 8) as grass from px group by 1, 2"),
    "slope_order": (_slopes, _SLOPES_SQL),
    "layer_agreement": (_agree, _GRID + " select count(*) as n, round(corr(v, v + grid_row * 100), 8) as corr from g where (grid_row + grid_col) % 7 > 0"),
    "window_by_period": (_periods, _PERIODS_SQL),
    "species_training": (_train, None),
}

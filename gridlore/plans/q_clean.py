"""Queries of cleaning and thinning, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.grid import GLOBAL_10M, USA_30S
from ..operators import clean, thin
from ..sources.tables import OCC_SQL, occ

BBOX = (-125.0, 24.0, -60.0, 50.0)
_OCC = f"with occ as ({OCC_SQL.format(events='events')})"
_CLEAN = _OCC + """, dup as (select *, row_number() over (partition by species, latitude, longitude order by rid) > 1 as is_dup from occ),
mag as (select round_even(latitude, 5) la, round_even(longitude, 5) lo, count(*) n, count(distinct species) s from occ where latitude is not null and longitude is not null group by 1, 2 having count(*) >= 25 and count(distinct species) >= 8),
cen as (select species, median(latitude) cla, median(longitude) clo, count(*) n from occ group by 1),
far as (select dup.*, cen.n as n_species, 12742.0 * asin(sqrt(least(greatest(pow(sin((radians(latitude) - radians(cla)) / 2), 2) + cos(radians(cla)) * cos(radians(latitude)) * pow(sin(radians(longitude - clo) / 2), 2), 0), 1))) as km from dup left join cen using (species)),
med as (select species, median(km) med from far group by 1),
mad as (select f.species, any_value(m.med) med, median(abs(f.km - m.med)) mad from far f join med m using (species) group by 1),
flags as (select far.*, mag.s is not null and (mag.s >= 30 or (round_even(abs(far.latitude) * 100, 6) % 1 = 0 and round_even(abs(far.longitude) * 100, 6) % 1 = 0)) as magnet,
  coalesce(n_species >= 20 and km > greatest(mad.med + 8 * 1.4826 * mad.mad, 3000), false) as outlier
  from far left join mag on round_even(far.latitude, 5) = mag.la and round_even(far.longitude, 5) = mag.lo left join mad using (species)),
cleaned as (select rid, species, latitude, longitude, year, case when latitude is null or longitude is null then 'bad_coordinate' when is_dup then 'duplicate' when abs(latitude) < 0.01 and abs(longitude) < 0.01 then 'null_island'
  when abs(abs(latitude) - abs(longitude)) <= 1e-6 + 1e-5 * abs(longitude) and abs(latitude) > 0.01 then 'lat_equals_lon' when not (latitude between 23.5 and 50.5 and longitude between -125.5 and -59.5) then 'outside'
  when magnet then 'magnet' when outlier then 'outlier' end as drop_reason from flags)"""
_GRID = "cast(floor((latitude - 90.0) / (-1.0 / 6.0)) as int) as grid_row, cast(floor((longitude + 180.0) / (1.0 / 6.0)) as int) as grid_col"
_THIN = _CLEAN + f""", g as (select *, {_GRID} from cleaned where drop_reason is null),
thinned as (select * from (select *, row_number() over (partition by species, grid_row, grid_col order by coalesce(year, -1) desc, rid) as k, count(*) over (partition by species, grid_row, grid_col) as n_records from g) where k = 1)"""


def _clean(s, d):
    return clean.clean(occ(s, d), BBOX)


def _thinned(s, d):
    return thin.thin(_clean(s, d).where("drop_reason is null"), GLOBAL_10M)


def _grid_keys(s, d):
    o, g = occ(s, d).where("latitude is not null"), USA_30S
    row, col = g.row(F.col("latitude")), g.col(F.col("longitude"))
    o = o.select("rid", row.alias("grid_row"), col.alias("grid_col"), g.cell_id(row, col).alias("cell_id"), g.inside(row, col).alias("inside"))
    return o.select("*", g.row_of(F.col("cell_id")).alias("row_back"), F.round(g.centre_lat(F.col("grid_row")), 8).alias("centre_lat"), F.round(g.centre_lon(F.col("grid_col")), 8).alias("centre_lon"))


def _cell_box(s, d):
    o = occ(s, d).where("latitude is not null")
    b = USA_30S.box(F.col("latitude"), F.col("longitude"))
    return o.select("rid", b.alias("b")).select("rid", *[F.round(f"b.{k}", 8).alias(k) for k in ("west", "south", "east", "north")])


def _decimals(s, d):
    return occ(s, d).select("rid", S.decimals(F.col("latitude")).alias("dec_lat"), S.decimals(F.col("longitude")).alias("dec_lon"), clean.whole_degree().alias("whole"), S.slug(F.concat_ws(" ", "species", "basis")).alias("slug"))


_DEC = "case when {0} is null then null when cast(round_even(abs({0}) * 1000000, 0) as bigint) % 1000000 = 0 then 0 when cast(round_even(abs({0}) * 1000000, 0) as bigint) % 100000 = 0 then 1 when cast(round_even(abs({0}) * 1000000, 0) as bigint) % 10000 = 0 then 2 when cast(round_even(abs({0}) * 1000000, 0) as bigint) % 1000 = 0 then 3 when cast(round_even(abs({0}) * 1000000, 0) as bigint) % 100 = 0 then 4 when cast(round_even(abs({0}) * 1000000, 0) as bigint) % 10 = 0 then 5 else 6 end"


def _species_list(s):
    return s.range(12).selectExpr("concat('species_', cast(id as string)) species").where("species not in ('species_3', 'species_7')")


def _listed(s, d):
    tax = s.range(12).selectExpr("concat('species_', cast(id as string)) species", "case when id % 4 = 3 then null when id % 4 = 2 then 'Animalia' else 'Plantae' end kingdom", "case when id % 4 = 0 then 'Tracheophyta' when id % 4 = 1 then 'Bryophyta' end phylum")
    df = clean.non_plants(clean.not_listed(occ(s, d), _species_list(s)), tax)
    return df.groupBy("species").agg(F.count("*").alias("n"), F.sum(F.col("not_listed").cast("int")).alias("n_not_listed"), F.sum(F.col("non_plant").cast("int")).alias("n_non_plant"))


def _distances(s, d):
    o = occ(s, d).where("latitude is not null")
    p = [F.lit(30.0), F.lit(-97.0), F.col("latitude"), F.col("longitude")]
    return o.select("rid", F.round(S.haversine_km(*p), 6).alias("km"), F.round(S.flat_km(*p), 6).alias("flat_km"), F.round(S.bearing(*p), 6).alias("bearing"), F.round(S.equal_area_x(F.lit(32.0), F.col("longitude")), 8).alias("x"))


QUERIES = {
    "clean_reasons": (lambda s, d: _clean(s, d).select("rid", "drop_reason"), _CLEAN + " select rid, drop_reason from cleaned"),
    "clean_reason_counts": (lambda s, d: _clean(s, d).groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n")), _CLEAN + " select coalesce(drop_reason, 'kept') as reason, count(*) as n from cleaned group by 1"),
    "thin_newest": (lambda s, d: _thinned(s, d).select("species", "grid_row", "grid_col", "rid", "year", "n_records"), _THIN + " select species, grid_row, grid_col, rid, year, n_records from thinned"),
    "thin_first": (lambda s, d: thin.thin(occ(s, d).where("latitude is not null"), GLOBAL_10M, newest=False).select("species", "grid_row", "grid_col", "rid", "n_records"), _OCC + f", g as (select *, {_GRID} from occ where latitude is not null) select species, grid_row, grid_col, rid, n_records from (select *, row_number() over (partition by species, grid_row, grid_col order by rid) k, count(*) over (partition by species, grid_row, grid_col) n_records from g) where k = 1"),
    "first_per_cell": (lambda s, d: thin.first_per_cell(occ(s, d), GLOBAL_10M).select("cell_id", "rid"), _OCC + f", g as (select *, {_GRID} from occ where latitude is not null) select cast(grid_row as bigint) * 2160 + grid_col as cell_id, min(rid) as rid from g where grid_row between 0 and 1079 and grid_col between 0 and 2159 group by 1"),
    "trainable_species": (lambda s, d: thin.cells_per_species(_thinned(s, d), 150), _THIN + " select species, count(*) as n_cells, cast(sum(n_records) as bigint) as n_records from thinned group by 1 having count(*) >= 150"),
    "clean_summary": (lambda s, d: thin.summary(_clean(s, d).where("drop_reason is null")), _CLEAN + ", k as (select * from cleaned where drop_reason is null), per as (select species, count(*) n from k group by 1 order by n desc, species limit 5) select count(*) as n_records, count(distinct species) as n_species, cast(floor(median(year)) as int) as median_year, round(100.0 * (select sum(n) from per) / count(*), 4) as top_share_pct from k"),
    "count_quantiles": (lambda s, d: thin.count_quantiles(occ(s, d)), _OCC + ", n as (select species, count(*) n from occ group by 1) select round(quantile_cont(n, 0.1), 6) as p10, round(quantile_cont(n, 0.5), 6) as p50, round(quantile_cont(n, 0.9), 6) as p90, max(n) as most from n"),
    "basis_shares": (lambda s, d: thin.shares(occ(s, d), "basis"), _OCC + " select basis, count(*) as n, round(cast(count(*) as double) / sum(count(*)) over (), 8) as share from occ where basis is not null group by 1"),
    "grid_keys": (_grid_keys, _OCC + ", g as (select rid, cast(floor((latitude - 49.5) / (-1.0 / 120.0)) as int) grid_row, cast(floor((longitude + 125.0) / (1.0 / 120.0)) as int) grid_col from occ where latitude is not null), h as (select *, cast(grid_row as bigint) * 7020 + grid_col as cell_id, grid_row between 0 and 3059 and grid_col between 0 and 7019 as inside from g) select *, cast(floor(cell_id / 7020.0) as int) as row_back, round(49.5 + (grid_row + 0.5) * (-1.0 / 120.0), 8) as centre_lat, round(-125.0 + (grid_col + 0.5) * (1.0 / 120.0), 8) as centre_lon from h"),
    "cell_box": (_cell_box, _OCC + ", g as (select rid, cast(floor((latitude - 49.5) / (-1.0 / 120.0)) as int) r, cast(floor((longitude + 125.0) / (1.0 / 120.0)) as int) c from occ where latitude is not null), h as (select *, r between 0 and 3059 and c between 0 and 7019 ok from g) select rid, case when ok then round(-125.0 + c * (1.0 / 120.0), 8) end as west, case when ok then round(49.5 + (r + 1) * (-1.0 / 120.0), 8) end as south, case when ok then round(-125.0 + (c + 1) * (1.0 / 120.0), 8) end as east, case when ok then round(49.5 + r * (-1.0 / 120.0), 8) end as north from h"),
    "coordinate_decimals": (_decimals, _OCC + f" select rid, {_DEC.format('latitude')} as dec_lat, {_DEC.format('longitude')} as dec_lon, coalesce(latitude % 1 = 0 and longitude % 1 = 0, false) as whole, trim(regexp_replace(concat_ws(' ', species, basis), '[^\\pL\\pN]', '_', 'g'), '_') as slug from occ"),
    "listed_and_plants": (_listed, _OCC + " select species, count(*) as n, cast(sum(case when species in ('species_3', 'species_7') then 1 else 0 end) as bigint) as n_not_listed, cast(sum(case when cast(substr(species, 9) as int) % 4 in (1, 2) then 1 else 0 end) as bigint) as n_non_plant from occ group by 1"),
    "distances": (_distances, _OCC + " select rid, round(12742.0 * asin(sqrt(least(greatest(pow(sin((radians(latitude) - radians(30.0)) / 2), 2) + cos(radians(30.0)) * cos(radians(latitude)) * pow(sin(radians(longitude + 97.0) / 2), 2), 0), 1))), 6) as km, round(sqrt(pow((longitude + 97.0) * 111.32 * cos(radians((latitude + 30.0) / 2)), 2) + pow((latitude - 30.0) * 110.574, 2)), 6) as flat_km, round((degrees(atan2((longitude + 97.0) * cos(radians((latitude + 30.0) / 2)), latitude - 30.0)) + 360.0) % 360.0, 6) as bearing, round(longitude * cos(radians(32.0)), 8) as x from occ where latitude is not null"),
}

"""Queries of strata, sentences, names, shapes and the remaining scalar functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import landcover as L
from ..operators import metrics as M
from ..operators import recommend as R
from ..operators import shapes, taxonomy
from ..operators import score as SC
from ..sources.tables import CELLS_SQL, OCC_SQL, cells, view

_CELLS = f"with occ as ({OCC_SQL.format(events='events')}), cells as ({CELLS_SQL.format(occ='occ')})"


def _strata(s, d):
    c = cells(s, d).withColumns({"tree_pct": F.col("tree") * 100, "crop_pct": F.col("aspect") / 4})
    return M.strata(c).groupBy("stratum").agg(F.count("*").alias("n"))


def _reason(s, d):
    c = cells(s, d)
    p = F.coalesce("tree", F.lit(0.1))
    return c.select("cell_id", R.reason(F.lit("Oak"), p, F.col("bio_1"), F.col("bio_12"), F.col("aspect") / 50).alias("reason"), R.describe_site(F.col("bio_1"), F.col("bio_12"), F.col("aspect") / 40, F.col("aspect") / 50, F.lit(None).cast("double")).alias("site"))


_REASON_SQL = _CELLS + """, x as (select *, coalesce(tree, 0.1) p, aspect / 50 d, aspect / 40 ph from cells),
y as (select *, concat(case when bio_1 is null or bio_12 is null then 'your climate' when bio_1 >= 18 and bio_12 < 500 then 'your warm, dry climate' when bio_1 >= 18 then 'your warm climate' when bio_1 < 8 then 'your cool climate' when bio_12 < 450 then 'your relatively dry climate' else 'your climate' end, case when d >= 5.5 then ' and well-drained ground' when d < 3.5 then ', though the soil here holds water' else '' end) pl,
 concat_ws(', ', case when bio_1 is not null then concat(case when bio_1 < 5 then 'cold' when bio_1 < 12 then 'cool' when bio_1 < 18 then 'mild' when bio_1 < 24 then 'warm' else 'hot' end, ' (yearly average about ', cast(cast(round_even(bio_1, 0) as int) as varchar), '°C)') end,
  case when bio_12 is not null then concat(case when bio_12 < 400 then 'dry' when bio_12 < 800 then 'moderately wet' else 'wet' end, ' (', cast(cast(bio_12 as int) as varchar), ' mm rain/year)') end,
  concat(case when ph < 5.5 then 'acidic soil' when ph < 7.3 then 'roughly neutral soil' else 'alkaline soil' end, ' (pH ', printf('%.1f', round(ph, 1)), ')'), case when d < 3.5 then 'slow-draining ground' when d < 5.5 then 'average drainage' else 'well-drained ground' end) bits from x)
select cell_id, case when p >= 0.7 then concat('Oak is a strong climate-and-soil match for ', pl, '.') when p >= 0.5 then concat('Oak can work in ', pl, ', with some care.') else concat('Oak is only a borderline match for ', pl, '.') end as reason, concat('This location looks ', bits, '.') as site from y"""


def _names(s, d):
    k = F.col("p_partkey")
    names = view(s, d, "part").select(F.concat(F.lit("Genus"), (k % 50).cast("string"), F.lit(" sp"), k.cast("string")).alias("name"), k)
    pick = lambda c, *v: F.element_at(F.array(*map(F.lit, v)), (c % len(v) + 1).cast("int"))
    match = names.where("p_partkey % 9 <> 0").select("name", k.alias("usageKey"), F.when(k % 5 == 0, k + 100000).alias("acceptedUsageKey"), pick(k, "SPECIES", "SPECIES", "GENUS").alias("rank"), pick(k, "Plantae", "Plantae", "Plantae", "Fungi").alias("kingdom"), F.when(k % 7 != 0, "Tracheophyta").alias("phylum"), F.when(k % 11 == 0, F.lit("Other sp")).otherwise(F.col("name")).alias("canonicalName"), F.lit("ACCEPTED").alias("status"))
    return taxonomy.resolve(names.select("name"), match)


_NAMES_SQL = """with n as (select p_partkey k, concat('Genus', cast(p_partkey % 50 as varchar), ' sp', cast(p_partkey as varchar)) as name from part),
x as (select *, case when k % 9 = 0 then 'no match' when k % 3 = 2 then 'rank GENUS' when k % 4 = 3 then 'not a plant' when k % 7 = 0 then 'not a vascular plant' when k % 11 = 0 then 'another genus' end as problem from n)
select name, case when problem is null then case when k % 5 = 0 then k + 100000 else k end end as key, case when problem is null then name end as accepted_name, problem from x"""


def _shape_parts(s, d):
    k = F.col("s_suppkey")
    ring = lambda x, y, w, h: F.array(*[F.struct((x + a * w).cast("double").alias("x"), (y + b * h).cast("double").alias("y")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))])
    rings = F.array(ring(k % 30, k % 40, k % 5 + 1, k % 3 + 1), ring(k % 30, k % 40, F.lit(0.5), F.lit(0.5)))
    return view(s, d, "supplier").select((k % 6).alias("shape"), k.alias("part"), rings.alias("rings"))


_PARTS_SQL = """with a as (select s_suppkey % 6 as shape, s_suppkey as part, (s_suppkey % 5 + 1) * (s_suppkey % 3 + 1) * cos(radians(s_suppkey % 40 + (s_suppkey % 3 + 1) / 2.0)) - 0.25 * cos(radians(s_suppkey % 40 + 0.25)) as area from supplier),
b as (select *, sum(area) over (partition by shape order by area desc, part) - area as before, sum(area) over (partition by shape) as total from a) select shape, part, round(area, 8) as area from b where before < 0.8 * total"""


def _scalars(s, d):
    k = F.col("p_partkey")
    at = F.col("p_size") * 7.3
    return view(s, d, "part").select(k, S.compass(at).alias("direction"), S.distance_phrase(F.col("p_size") / 3.0, at).alias("phrase"), S.decade_block(F.lit(1960) + k % 60).alias("decade"), F.round(S.circular_mean(F.cos(at), F.sin(at)), 6).alias("mean_aspect"), SC.booster_parameters(k * 3)["min_child_weight"].alias("child_weight"), L.texture_closes(F.col("p_size") * 1.0, F.lit(40.0), F.lit(30.0)).alias("closes"), F.array_join(R.cautions(F.col("p_name"), R.CAUTION_TOKENS), ",").alias("cautions"))


_DIRS = "[" + ", ".join(f"'{x}'" for x in S.COMPASS) + "]"
_SCALARS_SQL = f"""with x as (select p_partkey, p_size, p_name, p_size * 7.3::double a, {_DIRS}[cast(floor((p_size * 7.3::double) % 360 / 22.5 + 0.5) as int) % 16 + 1] dir from part)
select p_partkey, dir as direction, case when p_size / 3.0 < 1.5 then concat('under 2 km ', dir) else concat('about ', cast(cast(round_even(p_size / 3.0, 0) as int) as varchar), ' km ', dir) end as phrase, concat(cast((p_partkey % 60) // 10 * 10 + 1960 as varchar), '-', cast((p_partkey % 60) // 10 * 10 + 1969 as varchar)) as decade,
 round((degrees(atan2(cos(a), sin(a))) + 360) % 360, 6) as mean_aspect, case when p_partkey * 3 < 400 then 4 when p_partkey * 3 < 2000 then 6 else 10 end as child_weight, abs(p_size + 70.0 - 100) <= 5 as closes, '' as cautions from x"""

QUERIES = {
    "strata": (_strata, _CELLS + ", x as (select tree * 100 t, aspect / 4 c from cells) select 'all' as stratum, count(*) as n from x union all select 'low_tree', count(*) from x where t <= 10 and c is not null having count(*) > 0 union all select 'no_tree', count(*) from x where t <= 2 having count(*) > 0 union all select 'cropland', count(*) from x where t is not null and c >= 50 having count(*) > 0 union all select 'high_tree', count(*) from x where t >= 50 having count(*) > 0"),
    "reasons": (_reason, _REASON_SQL),
    "taxonomy_resolve": (_names, _NAMES_SQL),
    "largest_parts": (lambda s, d: shapes.largest_parts(shapes.part_areas(_shape_parts(s, d)), 0.8).select("shape", "part", F.round("area", 8).alias("area")), _PARTS_SQL),
    "scalar_functions": (_scalars, _SCALARS_SQL),
}

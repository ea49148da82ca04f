"""Queries of climate, land cover and smoothing, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.grid import GLOBAL_10M
from ..operators import cells as C
from ..operators import climate as K
from ..operators import landcover as L
from ..sources.tables import CELLS_SQL, OCC_SQL, cells, occ, view

_CELLS = f"with occ as ({OCC_SQL.format(events='events')}), cells as ({CELLS_SQL.format(occ='occ')})"
_MONTHS = _CELLS + """, m as (select cell_id, list_transform(range(1, 13), lambda m: cast((cell_id * 7 + m * 13) % 20 - 5 as double)) tmin,
 list_transform(range(1, 13), lambda m: cast((cell_id * 7 + m * 13) % 20 + (cell_id * 3 + m * 5) % 10 + 1 as double)) tmax, list_transform(range(1, 13), lambda m: cast((cell_id * 11 + m * 29) % 100 as double)) prec from cells)"""


def _months(s, d):
    m12 = F.sequence(F.lit(1), F.lit(12))
    c = F.col("cell_id")
    return cells(s, d).select("cell_id", F.transform(m12, lambda m: ((c * 7 + m * 13) % 20 - 5).cast("double")).alias("tmin"), F.transform(m12, lambda m: ((c * 7 + m * 13) % 20 + (c * 3 + m * 5) % 10 + 1).cast("double")).alias("tmax"), F.transform(m12, lambda m: ((c * 11 + m * 29) % 100).cast("double")).alias("prec"))


def _r(df, *cols, n=6):
    return df.withColumns({c: F.round(c, n) for c in cols})


_BIO = [f"bio_{k}" for k in range(1, 20)]
_BIO_SQL = _MONTHS + """, t as (select *, list_transform(range(1, 13), lambda i: (tmin[i] + tmax[i]) / 2) tavg, list_transform(range(1, 13), lambda i: tmax[i] - tmin[i]) rg, list_transform(range(0, 12), lambda i: prec[i + 1] + prec[(i + 1) % 12 + 1] + prec[(i + 2) % 12 + 1]) pq from m),
u as (select *, list_transform(range(0, 12), lambda i: (tavg[i + 1] + tavg[(i + 1) % 12 + 1] + tavg[(i + 2) % 12 + 1]) / 3) tq from t),
v as (select *, list_position(pq, list_max(pq)) w, list_position(pq, list_min(pq)) dr, list_position(tq, list_max(tq)) wa, list_position(tq, list_min(tq)) co from u)
select cell_id, round(list_avg(tavg), 6) as bio_1, round(list_avg(rg), 6) as bio_2, round(100 * list_avg(rg) / (list_max(tmax) - list_min(tmin)), 6) as bio_3, round(list_stddev_samp(tavg) * 100, 6) as bio_4, list_max(tmax) as bio_5, list_min(tmin) as bio_6, list_max(tmax) - list_min(tmin) as bio_7,
 round(tq[w], 6) as bio_8, round(tq[dr], 6) as bio_9, round(tq[wa], 6) as bio_10, round(tq[co], 6) as bio_11, list_sum(prec) as bio_12, list_max(prec) as bio_13, list_min(prec) as bio_14, round(100 * list_stddev_samp(prec) / (1 + list_avg(prec)), 6) as bio_15, pq[w] as bio_16, pq[dr] as bio_17, pq[wa] as bio_18, pq[co] as bio_19 from v"""


def _climatology(s, d):
    e = view(s, d, "events")
    m = e.select((F.col("user_id") % 50).alias("cell_id"), F.element_at(F.array(F.lit("tmin"), F.lit("tmax"), F.lit("prec")), (F.col("event_id") % 3 + 1).cast("int")).alias("var"), (F.col("event_id") % 12 + 1).cast("int").alias("month"), F.when(F.col("event_id") % 7 != 0, (F.col("event_id") % 100).cast("double")).alias("value"))
    return m


def _anom(s, d):
    a, b, f = F.col("bio_1"), F.col("bio_1") + 1, F.col("bio_1") + F.col("tree")
    p, q, r = F.col("bio_12"), F.col("bio_12") / 100, F.col("aspect")
    return cells(s, d).select("cell_id", F.round(K.anomaly(1, a, b, f), 6).alias("bio_1"), F.round(K.anomaly(12, p, q, r), 6).alias("bio_12"), F.round(K.downscale_prec(p, q, r), 6).alias("prec"))


def _pet(s, d):
    m = _months(s, d).withColumn("lat", GLOBAL_10M.centre_lat(GLOBAL_10M.row_of(F.col("cell_id"))))
    h = [K.hargreaves(F.get("tmin", k - 1), F.get("tmax", k - 1), F.col("lat"), k) for k in range(1, 13)]
    m = m.withColumn("pet", F.array(*h))
    total = F.aggregate("pet", F.lit(0.0), lambda x, y: x + y)
    return m.select("cell_id", F.round(total, 4).alias("pet"), F.round(K.water_deficit(F.col("prec"), F.col("pet")), 4).alias("deficit"), F.round(K.aridity(F.aggregate("prec", F.lit(0.0), lambda x, y: x + y), total), 6).alias("aridity"))


_PET_SQL = _MONTHS + """, c as (select m.*, radians(90.0 - (floor(cell_id / 2160.0) + 0.5) / 6.0) phi, [15, 45, 74, 105, 135, 166, 196, 227, 258, 288, 319, 349] dd, [31, 28.25, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31] nd from m),
x as (select c.cell_id, i, tmin[i] a, tmax[i] b, prec[i] p, phi, 1 + 0.033 * cos(2 * pi() * dd[i] / 365) dr, 0.409 * sin(2 * pi() * dd[i] / 365 - 1.39) de, nd[i] nd from c, range(1, 13) r(i)),
y as (select *, acos(greatest(least(-tan(phi) * tan(de), 1), -1)) su from x),
z as (select *, 24 * 60 / pi() * 0.082 * dr * (su * sin(phi) * sin(de) + cos(phi) * cos(de) * sin(su)) ra from y),
e as (select cell_id, p, greatest(0.0023 * ra / 2.45 * ((a + b) / 2 + 17.8) * sqrt(greatest(b - a, 0)), 0) * nd pet from z)
select cell_id, round(sum(pet), 4) as pet, round(sum(greatest(pet - p, 0)), 4) as deficit, round(sum(p) / greatest(sum(pet), 1e-6), 6) as aridity from e group by 1"""


def _pixels(s, d):
    o = view(s, d, "orders")
    return o.select((F.col("o_orderkey") % 40).alias("grid_row"), (F.col("o_custkey") % 30).alias("grid_col"), ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % 6).cast("int").alias("code"), (F.col("o_totalprice") / 1000).alias("z"), (F.col("o_custkey") % 60).cast("double").alias("slope"), (F.col("o_orderkey") % 360).cast("double").alias("aspect"))


_PX = "with px as (select o_orderkey % 40 grid_row, o_custkey % 30 grid_col, cast((o_orderkey * 7 + o_custkey) % 6 as int) code, o_totalprice / 1000 z, cast(o_custkey % 60 as double) slope, cast(o_orderkey % 360 as double) aspect from orders)"


def _fractions(s, d):
    f = L.class_fractions(_pixels(s, d), {"water": [1], "tree": [2, 3], "crop": [5]})
    code, purity = L.majority(["water", "tree", "crop"], [10, 20, 30])
    return _r(f.withColumns({"major": code, "purity": purity}), "water", "tree", "crop", "purity")


def _masked(s, d):
    c = cells(s, d)
    f = L.mask_findings(F.col("mask"))
    return c.select("cell_id", L.apply_exclusions(F.col("tree"), F.col("mask")).alias("score"), F.array_join(f["hard"], ",").alias("hard"), F.array_join(f["advisory"], ",").alias("advisory"))


def _mask_sql():
    bit = lambda names: "concat_ws(',', " + ", ".join(f"case when e & {b} <> 0 then '{n}' end" for n, b in names) + ")"
    return _CELLS + f", k as (select *, case when mask = 255 then 15 else mask end e from cells) select cell_id, case when e & 15 = 0 then tree end as score, {bit(L.MASK_BITS[:4])} as hard, {bit(L.MASK_BITS[4:])} as advisory from k"


def _made_mask(s, d):
    return cells(s, d).select("cell_id", L.exclusion_mask({"ocean": F.col("bio_12") < 100, "built_up": F.col("tree") >= 0.9, "cropland": F.col("aspect") > 180}, F.col("tree").isNotNull()).alias("mask"))


def _ndvi(s, d):
    e = view(s, d, "events").select((F.col("user_id") % 60).alias("cell_id"), (F.col("event_id") % 24).alias("slot"), F.when((F.col("event_id") % 5 != 0) & (F.col("user_id") % 60 < F.col("event_id") % 61 + 20), ((F.col("event_id") * 37) % 101) / 100.0).alias("value"))
    return e


_EV = "with e as (select user_id % 60 cell_id, event_id % 24 slot, case when event_id % 5 <> 0 and user_id % 60 < event_id % 61 + 20 then ((event_id * 37) % 101) / 100.0 end as value from events)"


def _soil(s, d):
    l = view(s, d, "lineitem").select((F.col("l_orderkey") % 500).alias("cell_id"), F.when(F.col("l_linenumber") != 3, F.col("l_quantity").cast("double")).alias("value"), (F.col("l_linenumber") * 5).cast("double").alias("thickness"))
    return _r(L.depth_mean(l, ["cell_id"]).withColumn("drainage", L.drainage(F.col("value"), F.lit(20.0))), "value", "drainage")


def _grid_values(s, d):
    i = F.col("c_custkey")  # rows of 30 cells, as many as there are customers
    return view(s, d, "customer").select(F.floor(i / 30).cast("int").alias("grid_row"), (i % 30).cast("int").alias("grid_col"), F.col("c_acctbal").cast("double").alias("v"))


def _smoothed(s, d):
    rows = view(s, d, "customer").count() // 30
    return _r(L.box_smooth(_grid_values(s, d), "v", 2, 3, rows, 30, 2), "v", n=6)


_GV = "with g as (select cast(c_custkey // 30 as int) grid_row, cast(c_custkey % 30 as int) grid_col, cast(c_acctbal as double) v from customer)"


def _smooth_sql(half_r, half_c, passes):
    out, k = _GV + ", s0 as (select * from g)", 0
    for _ in range(passes):
        for key, other, half in (("grid_row", "grid_col", half_r), ("grid_col", "grid_row", half_c)):
            out += f", s{k + 1} as (select a.grid_row, a.grid_col, (select sum(b.v) from s{k} b, range(-{half}, {half + 1}) o(o) where b.{other} = a.{other} and b.{key} = greatest(least(a.{key} + o, (select max({key}) from g)), 0)) / {2 * half + 1} v from s{k} a)"
            k += 1
    return out + f" select grid_row, grid_col, round(v, 6) as v from s{k}"


def _horn(s, d):
    return _r(L.horn(_grid_values(s, d), "v", 900.0, F.lit(45.0) - F.col("grid_row") / 120), "slope", "aspect")


_HORN = _GV + ", o as (select a.grid_row, a.grid_col, i, j, b.v from g a, (values (-1), (0), (1)) i(i), (values (-1), (0), (1)) j(j), g b where b.grid_row = a.grid_row + i and b.grid_col = a.grid_col + j), x as (select grid_row, grid_col, count(*) n, sum(v * j * (case when i = 0 then 2 else 1 end)) / (8 * 900.0 * cos(radians(45.0 - grid_row / 120.0))) dx, sum(v * i * (case when j = 0 then 2 else 1 end)) / (8 * 900.0) dy from o group by 1, 2) select grid_row, grid_col, case when n = 9 then round(degrees(atan(sqrt(dx * dx + dy * dy))), 6) end as slope, case when n = 9 then round((degrees(atan2(-dx, dy)) + 360) % 360, 6) end as aspect from x"


def _scalars(s, d):
    c = cells(s, d)
    cos, sin = S.circular(F.col("aspect"))
    ramp = S.ramp(F.col("tree"), (255, 250, 220), (20, 90, 40))
    return c.select("cell_id", F.round(cos, 8).alias("aspect_cos"), F.round(sin, 8).alias("aspect_sin"), S.as_fraction(F.col("bio_12")).alias("fraction"), F.round(S.sigmoid(F.col("bio_1") / 10), 8).alias("p"), F.when(S.any_null(["bio_1", "bio_12"]), 1.0).otherwise(0.0).alias("missing_climate"), F.round(S.missing_share(["bio_1", "bio_12", "tree"]), 8).alias("missing"), ramp["r"].alias("red"), ramp["g"].alias("green"), S.json_number(F.col("bio_1") / 3).alias("json"))


def _future(s, d):
    c = cells(s, d)
    f = c.where("cell_id % 4 <> 0").select("cell_id", (F.col("bio_1") + 2).alias("f_bio_1"), (F.col("bio_12") * 0.9).alias("f_bio_12"))
    j = c.join(f, "cell_id", "left")
    whole = F.col("f_bio_1").isNotNull() & F.col("f_bio_12").isNotNull()
    return j.select("cell_id", F.when(whole, F.round("f_bio_1", 6)).alias("bio_1"), F.when(whole, F.round("f_bio_12", 6)).alias("bio_12"), F.when(whole, F.col("tree")).alias("tree"), F.when(F.col("f_bio_1").isNull() & F.col("f_bio_12").isNull(), "no future cell").when(~whole, "a future layer is missing").alias("reason"))


QUERIES = {
    "bioclim": (lambda s, d: _r(K.bioclim(_months(s, d)).select("cell_id", *_BIO), *_BIO), _BIO_SQL),
    "climatology": (lambda s, d: _r(K.climatology(_climatology(s, d)), "value"), "with m as (select user_id % 50 cell_id, ['tmin', 'tmax', 'prec'][event_id % 3 + 1] as var, cast(event_id % 12 + 1 as int) as month, case when event_id % 7 <> 0 then cast(event_id % 100 as double) end as value from events) select cell_id, var, month, round(avg(value), 6) as value from m group by all"),
    "climate_anomaly": (_anom, _CELLS + ", x as (select cell_id, bio_1 a, bio_1 + 1 b, bio_1 + tree f, bio_12 p, bio_12 / 100 q, aspect r from cells) select cell_id, round(case when f is not null then a + (f - b) end, 6) as bio_1, round(case when p is not null then greatest(p * greatest(least(r / greatest(q, 1), 20), 0.05), 0) end, 6) as bio_12, round(case when p is null then null when q < 1 then greatest(p + (r - q), 0) else p * greatest(least(r / greatest(q, 1), 5), 0.2) end, 6) as prec from x"),
    "evaporation": (_pet, _PET_SQL),
    "window_comparison": (lambda s, d: _r(K.compare_windows(cells(s, d).withColumn("w2", F.col("bio_1") + F.col("tree") * 3), ["bio_1", "w2"]), "mean", "sd", "median", "p05", "p95", "shift", "share_over_0", "share_over_1"), _CELLS + ", c as (select bio_1 a, bio_1 + tree * 3 b from cells where bio_1 is not null and tree is not null), l as (select 'bio_1' w, a v, a from c union all select 'w2', b, a from c) select w as \"window\", round(avg(v), 6) as mean, round(stddev_pop(v), 6) as sd, round(median(v), 6) as median, round(quantile_cont(v, 0.05), 6) as p05, round(quantile_cont(v, 0.95), 6) as p95, round(avg(v - a), 6) as shift, round(avg(cast(v > a as int)), 6) as share_over_0, round(avg(cast(v - a > 1 as int)), 6) as share_over_1 from l group by w"),
    "coverage_loss": (lambda s, d: K.coverage_loss(cells(s, d), "bio_1", "bio_12", "grid_row"), _CELLS + " select grid_row, count(bio_1) as n_old, count(*) filter (bio_1 is not null and bio_12 is null) as n_lost from cells group by 1 having count(*) filter (bio_1 is not null and bio_12 is null) > 0 order by n_lost desc, grid_row limit 10"),
    "class_fractions": (_fractions, _PX + ", f as (select grid_row, grid_col, avg(case when code <> 0 then cast(code = 1 as int) end) w, avg(case when code <> 0 then cast(code in (2, 3) as int) end) t, avg(case when code <> 0 then cast(code = 5 as int) end) c, count(nullif(code, 0)) n from px group by 1, 2) select grid_row, grid_col, round(w, 6) as water, round(t, 6) as tree, round(c, 6) as crop, n as n_pixels, case when w >= t and w >= c then 10 when t >= c then 20 when c is not null then 30 end as major, round(greatest(w, t, c), 6) as purity from f"),
    "exclusions": (_masked, _mask_sql()),
    "exclusion_mask": (_made_mask, _CELLS + " select cell_id, case when tree is null then 255 else (case when bio_12 < 100 then 1 else 0 end) + (case when tree >= 0.9 then 8 else 0 end) + (case when aspect > 180 then 32 else 0 end) end as mask from cells"),
    "ndvi_summary": (lambda s, d: _r(L.ndvi_summary(_ndvi(s, d)), "mean", "most", "mean_top12", "range"), _EV + ", c as (select cell_id, slot, avg(value) v from e where value is not null group by 1, 2), r as (select *, row_number() over (partition by cell_id order by v desc) k from c), a as (select cell_id, cast(count(*) as int) n, avg(v) m, max(v) mx, avg(v) filter (k <= 12) t, max(v) - min(v) rg from r group by 1) select cell_id, n as n_slots, case when n >= 8 then round(m, 6) end as mean, case when n >= 8 then round(mx, 6) end as most, case when n >= 8 then round(t, 6) end as mean_top12, case when n >= 8 then round(rg, 6) end as range from a"),
    "moisture_summary": (lambda s, d: _r(L.moisture_summary(_ndvi(s, d).withColumn("month", F.col("slot") % 12)), "mean", "amplitude"), _EV + ", m as (select cell_id, slot % 12 mo, avg(value) v from e where value is not null group by 1, 2) select cell_id, round(avg(v), 6) as mean, round(max(v) - min(v), 6) as amplitude, count(*) as n_months from m group by 1"),
    "soil_depth_mean": (_soil, "with l as (select l_orderkey % 500 cell_id, case when l_linenumber <> 3 then cast(l_quantity as double) end v, l_linenumber * 5.0 t from lineitem), a as (select cell_id, sum(v * t) / sum(case when v is not null then t end) v from l group by 1) select cell_id, round(v, 6) as value, round(1 + 6 * greatest(least((v - 20 + 100) / 200, 1), 0), 6) as drainage from a"),
    "terrain": (lambda s, d: _r(L.terrain(_pixels(s, d), ["grid_row", "grid_col"]), "mean", "least", "most", "sd", "slope_q3", "northness", "eastness", "range", "strength", n=9), _PX + ", a as (select grid_row, grid_col, avg(z) me, min(z) mi, max(z) ma, sqrt(greatest(avg(z * z) - avg(z) * avg(z), 0)) sd, quantile_cont(slope, 0.75) q3, max(slope) sm, sum(cos(radians(aspect)) * slope) / nullif(sum(slope), 0) n, sum(sin(radians(aspect)) * slope) / nullif(sum(slope), 0) e from px group by 1, 2) select grid_row, grid_col, round(me, 9) as mean, round(mi, 9) as least, round(ma, 9) as most, round(sd, 9) as sd, round(q3, 9) as slope_q3, sm as slope_max, round(n, 9) as northness, round(e, 9) as eastness, round(ma - mi, 9) as range, round(sqrt(n * n + e * e), 9) as strength from a"),
    "block_mean": (lambda s, d: _r(C.block_mean(cells(s, d), 3, ["bio_1", "bio_12"]), "bio_1", "bio_12"), _CELLS + " select cast(floor(grid_row / 3.0) as int) as grid_row, cast(floor(grid_col / 3.0) as int) as grid_col, round(avg(bio_1), 6) as bio_1, round(avg(bio_12), 6) as bio_12 from cells group by 1, 2"),
    "box_smooth": (_smoothed, _smooth_sql(2, 3, 2)),
    "horn_slope": (_horn, _HORN),
    "effort_concentration": (lambda s, d: _r(L.concentration(occ(s, d).groupBy("latitude", "longitude").agg((F.count("*") - 1).alias("effort"))), "top_share", "zero_share"), f"with occ as ({OCC_SQL.format(events='events')}), e as (select count(*) - 1 as effort from occ group by latitude, longitude), r as (select effort, row_number() over (order by effort desc) k, count(*) over () n from e) select round(cast(sum(effort) filter (k <= greatest(floor(n / 100), 1)) as double) / sum(effort), 6) as top_share, round(avg(cast(effort = 0 as int)), 6) as zero_share from r"),
    "layer_ranges": (lambda s, d: _r(L.ranges(cells(s, d), {"bio_1": (-5, 30), "bio_12": (0, 3000)}), "coverage", "least", "most", "mean", "median", "within"), _CELLS + ", l as (select 'bio_1' layer, bio_1 v, -5 lo, 30 hi from cells union all select 'bio_12', bio_12, 0, 3000 from cells) select layer, count(v) as n, round(avg(cast(v is not null as int)), 6) as coverage, round(min(v), 6) as least, round(max(v), 6) as most, round(avg(v), 6) as mean, round(median(v), 6) as median, round(avg(cast(v between lo and hi as int)), 6) as within, avg(cast(v between lo and hi as int)) = 1 as ok from l group by 1"),
    "paired_bias": (lambda s, d: _r(L.paired_bias(_pixels(s, d), _pixels(s, d).withColumn("z", F.when(F.col("code") == 0, 0.0).otherwise(F.col("z") + 1)), ["grid_row", "grid_col"], "z"), "mean_diff", "most_diff"), _PX + ", a as (select grid_row, grid_col, avg(z) a, avg(case when code <> 0 then z + 1 end) b from px group by 1, 2) select round(avg(b - a), 6) as mean_diff, round(max(abs(b - a)), 6) as most_diff, count(*) as n from a where a is not null and b is not null"),
    "scalar_layers": (_scalars, _CELLS + " select cell_id, round(cos(radians(aspect)), 8) as aspect_cos, round(sin(radians(aspect)), 8) as aspect_sin, case when bio_12 > 1.5 then bio_12 / 100 else bio_12 end as fraction, round(1 / (1 + exp(-bio_1 / 10)), 8) as p, case when bio_1 is null or bio_12 is null then 1.0 else 0.0 end::double as missing_climate, round((cast(bio_1 is null as int) + cast(bio_12 is null as int) + cast(tree is null as int)) / 3.0, 8) as missing, cast(floor(255 + tree * (20 - 255) + 0.5) as int) as red, cast(floor(250 + tree * (90 - 250) + 0.5) as int) as green, round_even(bio_1 / 3, 6) as json from cells"),
    "future_vector": (_future, _CELLS + ", f as (select cell_id, bio_1 + 2 a, bio_12 * 0.9 b from cells where cell_id % 4 <> 0), j as (select cells.cell_id, tree, a, b from cells left join f using (cell_id)) select cell_id, case when a is not null and b is not null then round(a, 6) end as bio_1, case when a is not null and b is not null then round(b, 6) end as bio_12, case when a is not null and b is not null then tree end as tree, case when a is null and b is null then 'no future cell' when a is null or b is null then 'a future layer is missing' end as reason from j"),
}

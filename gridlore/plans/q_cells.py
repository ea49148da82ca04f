"""Queries of joins of points and cells and of background sampling, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.grid import GLOBAL_10M
from ..functions.scalar import hashed_uniform_sql
from ..operators import background as B
from ..operators import cells as C
from ..operators import thin
from ..sources.tables import CELLS_SQL, OCC_SQL, cells, occ, view, window

_OCC = f"with occ as ({OCC_SQL.format(events='events')})"
_CELLS = _OCC + f", cells as ({CELLS_SQL.format(occ='occ')})"
_PTS = _CELLS + ", pts as (select *, cast(floor((latitude - 90.0) / (-1.0 / 6.0)) as int) as grid_row, cast(floor((longitude + 180.0) / (1.0 / 6.0)) as int) as grid_col, cast(floor((latitude - 90.0) / (-1.0 / 6.0)) as bigint) * 2160 + cast(floor((longitude + 180.0) / (1.0 / 6.0)) as bigint) as cell_id from occ where latitude is not null)"


def _points(s, d):
    p = thin.on_grid(occ(s, d).where("latitude is not null"), GLOBAL_10M)
    return p.withColumn("cell_id", GLOBAL_10M.cell_id(F.col("grid_row"), F.col("grid_col")))


def _presence(s, d):
    return C.presence_pairs(_points(s, d))


def _overlay(s, d):
    part = view(s, d, "part")
    base = part.where("p_partkey % 7 <> 0").select("p_partkey", "p_brand", "p_size")
    extra = part.where("p_size > 25").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("X-"), "p_brand")).alias("p_brand"), (F.col("p_size") * 2).alias("p_size"))
    return C.overlay(base, extra, "p_partkey", ["p_brand", "p_size"])


def _precedence(s, d):
    c = cells(s, d)
    return C.precedence(c.where("cell_id % 3 <> 0").select("cell_id", F.col("bio_1").alias("v")), c.where("cell_id % 5 <> 0").select("cell_id", (F.col("bio_12") / 10).alias("v")), "cell_id", "v")


def _faithful(s, d):
    c = cells(s, d)
    return C.faithful(C.shift_clip(c, (330, 355), (480, 509)), c, "bio_1", 330, 480)


def _ring(s, d):
    return C.ring_fallback(_points(s, d).select("rid", "grid_row", "grid_col"), cells(s, d), "bio_1")


def _nearest(s, d):
    from ..functions.grid import GLOBAL_10M as g

    return C.nearest_cells(cells(s, d), 32.0, -97.0, g, 60.0).select("cell_id", F.round("km", 6).alias("km"))


def _tiles(s, d):
    o = occ(s, d).where("latitude is not null")
    return o.select("longitude", "latitude", (F.col("longitude") + 0.1).alias("east"), (F.col("latitude") - 0.1).alias("south"))


def _accumulate(s, d):
    p = _tiles(s, d).select(F.col("longitude").alias("west"), "south", "east", F.col("latitude").alias("north"), F.lit(1.0).alias("n"))
    return C.tile_accumulate(p, GLOBAL_10M).select("grid_row", "grid_col", F.round("total", 6).alias("total"))


_ACC = _OCC + """, b as (select (longitude + 180.0) / (1.0/6.0) x0, (longitude + 0.1 + 180.0) / (1.0/6.0) x1, (latitude - 90.0) / (-1.0/6.0) y0, (latitude - 0.1 - 90.0) / (-1.0/6.0) y1 from occ where latitude is not null),
 e as (select b.*, floor(y0) + i.i as r, floor(x0) + j.j as c from b, (values (0), (1)) i(i), (values (0), (1)) j(j)),
 w as (select cast(r as int) grid_row, cast(((c % 2160) + 2160) % 2160 as int) grid_col, greatest(least(x1, c + 1) - greatest(x0, c), 0.0) / (x1 - x0) * greatest(least(y1, r + 1) - greatest(y0, r), 0.0) / (y1 - y0) as n from e)
 select grid_row, grid_col, round(sum(n), 6) as total from w where n > 0 and grid_row between 0 and 1079 group by 1, 2"""


def _bilinear(s, d):
    c = cells(s, d)
    p = _points(s, d).select("rid", ((F.col("latitude") - 90.0) * -6.0).alias("y"), ((F.col("longitude") + 180.0) * 6.0).alias("x"))
    return C.bilinear(c, "bio_12", p).select("rid", F.round("bio_12", 5).alias("bio_12"))


def _bilinear_filled(s, d):
    c = cells(s, d).withColumn("v", F.when(F.col("cell_id") % 4 == 0, F.col("bio_12")))
    p = _points(s, d).select("rid", ((F.col("latitude") - 90.0) * -6.0).alias("y"), ((F.col("longitude") + 180.0) * 6.0).alias("x"))
    return C.bilinear_filled(c, "v", p).select("rid", F.round("v", 5).alias("v"))


_FILLED = _PTS + """, c as (select *, case when cell_id % 4 = 0 then bio_12 end v from cells), p as (select rid, (latitude - 90.0) * -6.0 y, (longitude + 180.0) * 6.0 x from pts),
 q as (select rid, y - 0.5 y, x - 0.5 x, i.i, j.j from p, (values (0), (1)) i(i), (values (0), (1)) j(j)),
 h as (select rid, c.v, (case when i = 1 then y - floor(y) else 1 - (y - floor(y)) end) * (case when j = 1 then x - floor(x) else 1 - (x - floor(x)) end) w from q join c on c.grid_row = cast(floor(y) as int) + i and c.grid_col = cast(floor(x) as int) + j where c.v is not null),
 b as (select rid, case when sum(w) <> 0 then sum(v * w) / sum(w) end v from h group by 1),
 o as (select i - 2 dr, j - 2 dc, greatest(abs(i - 2), abs(j - 2)) ring from range(5) a(i), range(5) b(j)),
 n as (select p.rid, c.v, row_number() over (partition by p.rid order by o.ring, c.grid_row, c.grid_col) k from p, o, c where c.grid_row = cast(floor(p.y) as int) + o.dr and c.grid_col = cast(floor(p.x) as int) + o.dc and c.v is not null)
 select p.rid, round(coalesce(b.v, n.v), 5) as v from p left join b using (rid) left join n on n.rid = p.rid and n.k = 1"""


def _cell_merge(s, d):
    pr = _presence(s, d)
    return C.cell_table(pr.where("species = 'species_1'"), pr.where("species in ('species_2', 'species_3')"), cells(s, d).where("cell_id % 2 = 0").select("cell_id"))


def _target_group(s, d):
    return B.target_group(_points(s, d).select("rid", "species", "cell_id"))


_TG = _PTS + """, pr as (select distinct species, cell_id from pts), n as (select species, least(count(*), 25000) n from pr group by 1),
 pool as (select rid, cell_id, """ + hashed_uniform_sql("rid") + """ u from pts),
 cand as (select n.species, n.n, pool.* from pool, n where not exists (select 1 from pr where pr.species = n.species and pr.cell_id = pool.cell_id)),
 k as (select *, row_number() over (partition by species order by u, rid) j from cand) select species, rid, cell_id from k where j <= n"""


def _padded(s, d):
    p = _points(s, d).where("species = 'species_4' and longitude < -98 and latitude > 33")
    c = cells(s, d).withColumns({"latitude": GLOBAL_10M.centre_lat(F.col("grid_row")), "longitude": GLOBAL_10M.centre_lon(F.col("grid_col"))})
    return B.padded_pool(c.select("cell_id", "latitude", "longitude"), p, 300).select("cell_id", "pad")


def _weights(s, d):
    e = _points(s, d).groupBy("cell_id").agg(F.count("*").cast("double").alias("effort"))
    return B.effort_weights(e, 0.5)


_W = _PTS + ", e as (select cell_id, cast(count(*) as double) effort from pts group by 1), w as (select e.*, pow(effort + (select median(effort) / 20 from e where effort > 0), 0.5) weight from e)"


def _overlap_tiles(s, d):
    """A tile for each customer, of a side by its nation, and the tiles that meet each of two extents."""
    k, side = F.col("c_custkey"), (F.col("c_nationkey") % 4 + 1) * 2.5
    west, south = (k % 36 * 10 - 180).cast("double"), (F.floor(k / 36) % 14 * 10 - 50).cast("double")
    t = view(s, d, "customer").select(k.alias("tile"), west.alias("west"), south.alias("south"), (west + side).alias("east"), (south + side).alias("north"))
    both = [C.tiles_in(t, box).select(F.lit(i).alias("extent"), "tile") for i, box in enumerate(((-100.0, 30.0, -90.0, 35.0), (-13.0, 12.5, 44.0, 41.0)))]
    return both[0].unionByName(both[1])


_TILES_SQL = """with t as (select c_custkey as tile, c_custkey % 36 * 10 - 180 as w, c_custkey // 36 % 14 * 10 - 50 as s, (c_nationkey % 4 + 1) * 2.5 as side from customer),
x(extent, w0, s0, w1, s1) as (values (0, -100, 30, -90, 35), (1, -13, 12.5, 44, 41))
select extent, tile from t join x on w < w1 and w + side > w0 and s < s1 and s + side > s0"""


def _dedupe(s, d):
    e = view(s, d, "events").select(F.col("event_id").alias("rid"), "user_id", F.when(F.col("event_id") % 5 == 0, None).otherwise(F.col("event_id") % 1000).alias("k2"))
    return C.dedupe_two_keys(e, "user_id", "k2").select("rid")


QUERIES = {
    "cell_lookup": (lambda s, d: C.lookup(_points(s, d), cells(s, d).where("cell_id % 5 <> 0"), ["bio_1", "bio_12"]).select("rid", "bio_1", "bio_12"), _PTS + " select rid, c.bio_1, c.bio_12 from pts left join (select * from cells where cell_id % 5 <> 0) c using (cell_id)"),
    "cell_window": (lambda s, d: window(cells(s, d), GLOBAL_10M, -98.0, 31.0, -96.5, 33.0).select("cell_id"), _CELLS + " select cell_id from cells where grid_row between 342 and 353 and grid_col between 492 and 500"),
    "coarse_lookup": (lambda s, d: C.lookup_coarse(_points(s, d).select("rid", "grid_row", "grid_col"), C.block_mean(cells(s, d), 4, ["bio_12"]), 4, ["bio_12"]).select("rid", F.round("bio_12", 5).alias("bio_12")), _PTS + ", b as (select cast(floor(grid_row / 4.0) as int) r, cast(floor(grid_col / 4.0) as int) c, avg(bio_12) v from cells group by 1, 2) select rid, round(b.v, 5) as bio_12 from pts left join b on cast(floor(grid_row / 4.0) as int) = b.r and cast(floor(grid_col / 4.0) as int) = b.c"),
    "invalid_cells": (lambda s, d: C.invalid_cells(_points(s, d), cells(s, d), "bio_1", GLOBAL_10M).select("rid", "invalid_cell"), _PTS + " select rid, c.bio_1 is null as invalid_cell from pts left join cells c using (cell_id)"),
    "ocean_flag": (lambda s, d: C.ocean(_points(s, d), cells(s, d).withColumn("land_pct", F.col("tree") * 100), "land_pct").select("rid", "ocean"), _PTS + " select rid, not coalesce(c.tree * 100 >= 1, false) as ocean from pts left join cells c using (cell_id)"),
    "shared_universe": (lambda s, d: C.shared_universe(cells(s, d).select("cell_id"), _presence(s, d), "species_5"), _PTS + " select cell_id, case when exists (select 1 from pts where pts.cell_id = cells.cell_id and species = 'species_5') then 1 else 0 end as y from cells"),
    "cell_table_merge": (_cell_merge, _PTS + ", p as (select distinct cell_id from pts where species = 'species_1'), b as (select distinct cell_id from pts where species in ('species_2', 'species_3')), s as (select cell_id from cells where cell_id % 2 = 0), m as (select cell_id, cast(p.cell_id is not null as int) as has_record, cast(b.cell_id is not null as int) as is_background from p full outer join b using (cell_id)), n as (select m.*, cast(s.cell_id is not null as int) as surveyed from m left join s using (cell_id)) select *, greatest(has_record, surveyed) as mask from n"),
    "multi_hot": (lambda s, d: C.multi_hot(_presence(s, d), ["species_1", "species_2"]), _PTS + " select cell_id, max(cast(species = 'species_1' as int)) as species_1, max(cast(species = 'species_2' as int)) as species_2 from pts group by 1"),
    "anti_presence": (lambda s, d: B.anti_presence(_points(s, d), _presence(s, d), "species_2").select("rid"), _PTS + " select rid from pts where cell_id not in (select cell_id from pts where species = 'species_2')"),
    "traits_overlay": (_overlay, "with b as (select p_partkey, p_brand, p_size from part where p_partkey % 7 <> 0), e as (select p_partkey, case when p_partkey % 3 = 0 then concat('X-', p_brand) end p_brand, p_size * 2 p_size from part where p_size > 25) select p_partkey, coalesce(e.p_brand, b.p_brand) as p_brand, coalesce(e.p_size, b.p_size) as p_size from b full outer join e using (p_partkey)"),
    "append_unmatched": (lambda s, d: C.unmatched(view(s, d, "part").where("p_partkey % 4 = 0").select("p_partkey", "p_size"), view(s, d, "part").where("p_size > 40").select("p_partkey"), "p_partkey"), "select p_partkey, p_size from part where p_partkey % 4 = 0 union all select p_partkey, null from part where p_size > 40 and p_partkey % 4 <> 0"),
    "source_precedence": (_precedence, _CELLS + ", p as (select cell_id, bio_1 v from cells where cell_id % 3 <> 0), b as (select cell_id, bio_12 / 10 v from cells where cell_id % 5 <> 0) select cell_id, coalesce(p.v, b.v) as v, case when p.v is not null then 1 when b.v is not null then 2 else 0 end as source from p full outer join b using (cell_id)"),
    "common_validity": (lambda s, d: C.common_validity([cells(s, d)] * 3, "cell_id", ["bio_1", "bio_12", "tree"]), _CELLS + " select cell_id, bio_1, bio_12, tree from cells where bio_1 is not null and bio_12 is not null and tree is not null"),
    "clip_faithful": (_faithful, _CELLS + " select count(*) as n, count(*) as n_equal, cast(0 as bigint) as n_outside from cells where grid_row between 330 and 355 and grid_col between 480 and 509"),
    "ring_fallback": (_ring, _PTS + ", o as (select i - 2 dr, j - 2 dc, greatest(abs(i - 2), abs(j - 2)) ring from range(5) a(i), range(5) b(j)), h as (select p.rid, c.bio_1, o.ring, row_number() over (partition by p.rid order by o.ring, c.grid_row, c.grid_col) k from pts p, o, cells c where c.grid_row = p.grid_row + o.dr and c.grid_col = p.grid_col + o.dc and c.bio_1 is not null) select pts.rid, h.bio_1, cast(h.ring as int) as ring from pts left join h on pts.rid = h.rid and h.k = 1"),
    "nearest_cells": (_nearest, _CELLS + ", k as (select cell_id, grid_row, grid_col, sqrt(pow((-180.0 + (grid_col + 0.5) / 6.0 + 97.0) * 111.32 * cos(radians((90.0 - (grid_row + 0.5) / 6.0 + 32.0) / 2)), 2) + pow((90.0 - (grid_row + 0.5) / 6.0 - 32.0) * 110.574, 2)) km from cells) select cell_id, round(km, 6) as km from k where km <= 60 order by k.km, grid_row, grid_col limit 48"),
    "tile_accumulate": (_accumulate, _ACC),
    "tiles_in_extent": (_overlap_tiles, _TILES_SQL),
    "bilinear": (_bilinear, _PTS + ", p as (select rid, (latitude - 90.0) * -6.0 - 0.5 y, (longitude + 180.0) * 6.0 - 0.5 x from pts), q as (select p.*, i.i, j.j from p, (values (0), (1)) i(i), (values (0), (1)) j(j)), h as (select rid, c.bio_12, (case when i = 1 then y - floor(y) else 1 - (y - floor(y)) end) * (case when j = 1 then x - floor(x) else 1 - (x - floor(x)) end) w from q join cells c on c.grid_row = cast(floor(y) as int) + i and c.grid_col = cast(floor(x) as int) + j where c.bio_12 is not null) select pts.rid, round(g.v, 5) as bio_12 from pts left join (select rid, case when sum(w) <> 0 then sum(bio_12 * w) / sum(w) end v from h group by 1) g using (rid)"),
    "bilinear_filled": (_bilinear_filled, _FILLED),
    "pad_to_grid": (lambda s, d: C.pad_to(C.shift_clip(cells(s, d), (340, 349), (485, 496)), 12, 14).agg(F.count("*").alias("n"), F.count("cell_id").alias("n_cells"), F.sum("grid_row").alias("rows")), _CELLS + " select cast(168 as bigint) as n, count(*) as n_cells, cast(924 as bigint) as rows from cells where grid_row between 340 and 349 and grid_col between 485 and 496"),
    "dedupe_two_keys": (_dedupe, "with a as (select event_id rid, user_id, case when event_id % 5 = 0 then null else event_id % 1000 end k2 from events), b as (select *, row_number() over (partition by user_id order by rid) k from a), c as (select * from b where user_id is null or k = 1), e as (select *, row_number() over (partition by k2 order by rid) j from c) select rid from e where k2 is null or j = 1"),
    "cell_set_operations": (lambda s, d: _sets(s, d), _PTS + ", a as (select distinct cell_id from pts where species = 'species_1'), b as (select distinct cell_id from pts where species = 'species_2') select (select count(*) from (select * from a union select * from b)) as n_union, (select count(*) from (select * from a intersect select * from b)) as n_both, (select count(*) from (select * from a except select * from b)) as n_first"),
    "target_group_background": (_target_group, _TG),
    "uniform_sample": (lambda s, d: B.sample_rows(_points(s, d).select("rid"), 500), _PTS + f", p as (select rid from pts order by {hashed_uniform_sql('rid')}, rid limit 500) select rid from p"),
    "padded_pool": (_padded, _PTS + ", p as (select * from pts where species = 'species_4' and longitude < -98 and latitude > 33), x as (select min(latitude) s, max(latitude) n, min(longitude) w, max(longitude) e from p), f as (select cell_id, 90.0 - (grid_row + 0.5) / 6.0 la, -180.0 + (grid_col + 0.5) / 6.0 lo from cells where cell_id not in (select cell_id from p)), g as (select cell_id, (select min(pad) from (values (0.25), (0.5), (1.0), (2.0), (4.0)) v(pad) where la between s - pad and n + pad and lo between w - pad and e + pad) pad from f, x), t as (select pad, sum(count(*)) over (order by pad) upto from g where pad is not null group by pad), c as (select coalesce(min(case when upto >= 300 then pad end), max(pad)) chosen from t) select cell_id, cast(pad as double) as pad from g, c where pad <= chosen"),
    "effort_weights": (lambda s, d: _weights(s, d).select("cell_id", "effort", F.round("weight", 8).alias("weight")), _W + " select cell_id, effort, round(weight, 8) as weight from w"),
    "effort_sample": (lambda s, d: B.weighted_without(_weights(s, d), 200).select("cell_id"), _W + f" select cell_id from w where weight > 0 order by -ln({hashed_uniform_sql('cell_id')}) / weight, cell_id limit 200"),
    "effort_sample_replaced": (lambda s, d: B.weighted_with(_weights(s, d), 2000).select("cell_id", "times"), _W + ", x as (select cell_id, round(sum(weight) over (order by cell_id) / sum(weight) over () * 2000, 9) b, round((sum(weight) over (order by cell_id) - weight) / sum(weight) over () * 2000, 9) a from w where weight > 0) select cell_id, cast(floor(b + 0.5) - floor(a + 0.5) as int) as times from x where floor(b + 0.5) - floor(a + 0.5) > 0"),
    "stratified_share": (lambda s, d: B.stratified_share(occ(s, d).withColumn("stratum", F.col("basis")), 40).select("species", "rid"), _OCC + ", n as (select species, count(distinct basis) s from occ group by 1), r as (select species, basis, rid, row_number() over (partition by species, basis order by rid) k from occ), f as (select r.species, rid, k <= ceil(40.0 / s) first from r join n using (species)), j as (select *, row_number() over (partition by species order by first desc, rid) j from f) select species, rid from j where j <= 40"),
}


def _sets(s, d):
    pr = _presence(s, d)
    a, b = (pr.where(F.col("species") == x).select("cell_id") for x in ("species_1", "species_2"))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [n(a.union(b).distinct(), "n_union"), n(a.intersect(b), "n_both"), n(a.subtract(b), "n_first")]
    out = parts[0].unionByName(parts[1], True).unionByName(parts[2], True)
    return out.agg(*[F.max(c).alias(c) for c in ("n_union", "n_both", "n_first")])

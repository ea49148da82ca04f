"""Queries of recommendation and scoring, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import recommend as R
from ..operators import score as SC
from ..sources import tables as T
from ..sources.tables import CELLS_SQL, OCC_SQL, cells, view

_CELLS = f"with occ as ({OCC_SQL.format(events='events')}), cells as ({CELLS_SQL.format(occ='occ')})"
_GOALS = ("shade", "fruit", "timber")

#: Scores of species at sites: parts stand for species, sites by part of the key.
_SC = """with sc as (select p_partkey as seq, cast(p_partkey % 25 as int) as site, concat('sp_', cast(p_partkey as string)) as species, cast((p_partkey * 7919) % 101 as double) / 100 as p,
 case when p_partkey % 9 = 0 then null else cast(60 + (p_partkey * 31) % 40 as double) / 100 end as auc, p_size as occupancy, cast((p_partkey * 13) % 6 as int) as n_folds, p_partkey % 11 = 0 as avoid,
 case when p_partkey % 4 = 0 then null else p_partkey % 3 <> 0 end as passes, cast((p_partkey * 17) % 1000 as double) / 10 as percentile from part)"""


def _sc(s, d):
    k = F.col("p_partkey")
    return view(s, d, "part").select(k.alias("seq"), (k % 25).cast("int").alias("site"), F.concat(F.lit("sp_"), k.cast("string")).alias("species"), (((k * 7919) % 101).cast("double") / 100).alias("p"), F.when(k % 9 == 0, None).otherwise((60 + (k * 31) % 40).cast("double") / 100).alias("auc"), F.col("p_size").alias("occupancy"), ((k * 13) % 6).cast("int").alias("n_folds"), (k % 11 == 0).alias("avoid"), F.when(k % 4 == 0, None).otherwise(k % 3 != 0).alias("passes"), (((k * 17) % 1000).cast("double") / 10).alias("percentile"))


def _notes(s, d):
    c = _sc(s, d)
    return c.select("seq", R.confidence(F.col("p"), F.col("auc"), F.col("n_folds")).alias("confidence"), R.future_note(F.col("p"), F.when(F.col("seq") % 5 != 0, F.col("percentile") / 100)).alias("note"), R.bucket(F.col("avoid"), F.col("auc"), F.col("occupancy") * 20).alias("bucket"))


_NOTES_SQL = _SC + """, x as (select *, case when seq % 5 <> 0 then percentile / 100 end f from sc) select seq, case when p >= 0.7 and auc >= 0.85 and n_folds >= 4 then 'Looks like records' when p >= 0.5 and auc >= 0.75 then 'Somewhat like records' else 'Weak likeness' end as confidence,
 case when f is null then '' when f >= 0.7 and f - p >= -0.05 then '' when f - p <= -0.15 then concat('Record-likeness drops ', cast(cast(round_even((p - f) * 100, 0) as int) as varchar), '% under 2050 BIO.') when f - p >= 0.1 then concat('Record-likeness rises ', cast(cast(round_even((f - p) * 100, 0) as int) as varchar), '% under 2050 BIO.') else '' end as note,
 case when avoid then 'invasive' when auc is null or auc >= 0.7 then 'well_matched' when occupancy * 20 >= 400 then 'general' else 'unrankable' end as bucket from x"""


def _quota(s, d):
    c = _sc(s, d).withColumn("group", R.bucket(F.col("avoid"), F.col("auc"), F.col("occupancy") * 20))
    return R.quota_rank(c)


_QUOTA_SQL = _SC + """, g as (select *, case when avoid then 'invasive' when auc is null or auc >= 0.7 then 'well_matched' when occupancy * 20 >= 400 then 'general' else 'unrankable' end as grp, cast(coalesce(passes = false, false) as int) below from sc),
k as (select *, row_number() over (partition by site, grp order by below, percentile desc, species) k from g where grp <> 'unrankable'),
n as (select site, count(*) filter (grp = 'well_matched') w, count(*) filter (grp = 'general') ge from k group by 1), m as (select *, greatest(0, least(5 - greatest(0, least(3, w, 5)), ge)) ng from n), q as (select *, greatest(0, least(w, 5 - ng)) nw from m),
p as (select k.site, species, grp, percentile, row_number() over (partition by k.site order by cast(grp <> 'well_matched' as int), below, percentile desc, species) r from k join q using (site) where (grp = 'well_matched' and k <= nw) or (grp = 'general' and k <= ng)),
i as (select site, species, grp, percentile, row_number() over (partition by site order by k) r from k where grp = 'invasive' and percentile >= 75)
select site, species, grp as "group", percentile, cast(r as int) as rank from p union all select site, species, grp, percentile, cast(r as int) from i where r <= 5"""


def _site(s, d):
    c = cells(s, d)
    x = R.site_filter(F.col("tree") * 0.8, F.col("aspect") / 360, F.lit(None).cast("double"), F.col("bio_12") / 25, F.col("tree"), F.col("bio_1") / 40, F.col("tree"))
    c = c.withColumn("x", x)
    return c.select("cell_id", "x.blocked", F.array_join("x.notes", ",").alias("notes"), R.cell_status(F.col("x.blocked"), F.col("bio_12") / 25, F.col("tree")).alias("status"))


_SITE_SQL = _CELLS + """, f as (select cell_id, tree * 0.8 e, case when aspect / 360 > 1.5 then aspect / 36000 else aspect / 360 end w, case when bio_12 / 25 > 1.5 then bio_12 / 2500 else bio_12 / 25 end b, tree c, bio_1 / 40 t, tree n from cells),
 g as (select *, coalesce(e > 0.5, false) or coalesce(w >= 0.5, false) blocked from f)
 select cell_id, blocked, concat_ws(',', case when e > 0.5 then 'excluded' end, case when w >= 0.5 then 'water' end, case when b >= 0.4 then 'built-up' end, case when c >= 0.5 then 'cropland' end, case when t >= 0.4 then 'tree cover' when n >= 0.6 then 'green' end) as notes, case when blocked then 'blocked' when b >= 0.4 then 'city' when c >= 0.5 then 'farm' else 'plantable' end as status from g"""


def _traits(s, d):
    k = F.col("p_partkey")
    return view(s, d, "part").select(k, F.concat_ws(" ", F.element_at(F.array(*[F.lit(g) for g in ("Acer", "Quercus", "Tilia", "Ulmus")]), (k % 4 + 1).cast("int")), "p_brand").alias("species"), F.array(*[F.when(k % (i + 2) == 0, F.lit(g)) for i, g in enumerate(_GOALS)]).alias("goals"), F.element_at(F.array(F.lit("full"), F.lit("part"), F.lit("shade")), (k % 3 + 1).cast("int")).alias("sun"), F.when(k % 13 == 0, F.array(F.lit("Europe"))).otherwise(F.array().cast("array<string>")).alias("invasive_in"), F.when(k % 17 == 0, F.lit("Said to be Invasive here")).alias("warning"), F.array(F.lit("USA")).alias("native_regions"))


def _traits_out(s, d):
    t = _traits(s, d)
    return t.select("p_partkey", R.do_not_plant(F.col("invasive_in"), F.col("warning")).alias("avoid"), R.goal_filter(F.col("goals"), F.col("sun"), "fruit", "shade").alias("fits"), R.default_common_name(F.col("species"), {"Acer": "Maple", "Quercus": "Oak"}).alias("common_name"), R.origin(F.when(F.col("p_partkey") % 2 == 0, "Europe").otherwise("USA"), F.col("native_regions"), F.col("invasive_in")).alias("origin"), R.country_region(F.when(F.col("p_partkey") % 2 == 0, " France").otherwise("Peru"), {"Europe": ["France", "Spain"]}).alias("region"))


def _importance(s, d):
    l = view(s, d, "lineitem").select(F.concat(F.lit("s"), (F.col("l_suppkey") % 12).cast("string")).alias("species"), (F.col("l_partkey") % 40).cast("string").alias("feature"), F.col("l_quantity").cast("double").alias("gain"))
    g = l.groupBy("species", "feature").agg(F.sum("gain").alias("gain"))
    return R.importance(g).select("species", "feature", F.round("share", 8).alias("share"), "rank")


def _models(s, d):
    c = _sc(s, d).select("species", F.when(F.col("seq") % 5 == 0, "skip_few_cells").otherwise("saved").alias("status"), "auc", F.concat(F.lit("m/"), "species").alias("model_path"))
    return c, c.where("cast(substr(species, 4) as int) % 7 <> 0").select("model_path")


def _runs(s, d):
    r = view(s, d, "supplier").select((F.col("s_suppkey") % 8).alias("country"), F.element_at(F.array(F.lit(1 / 120), F.lit(1 / 6)), (F.col("s_suppkey") % 2 + 1).cast("int")).alias("cell_deg"), F.concat(F.lit("p"), (F.col("s_suppkey") % 3).cast("string")).alias("profile"), ((F.col("s_suppkey") * 7) % 50).alias("n_species"), F.col("s_suppkey").alias("mtime"), F.col("s_name").alias("path"))
    return T.discover_runs(r, "p1").select("country", "path")


def _incomplete(s, d):
    o = view(s, d, "orders").select((F.col("o_custkey") % 100).alias("species"))
    meta = s.range(10, 110).select(F.col("id").alias("species"), F.when(F.col("id") % 3 == 0, 150).when(F.col("id") >= 100, 0).otherwise(F.col("id")).alias("claimed"))
    return R.incomplete(o, meta)


def _countries(s, d):
    c = view(s, d, "orders").groupBy((F.col("o_custkey") % 7).alias("country"), (F.col("o_orderkey") % 60).alias("species")).agg(F.count("*").alias("n"))
    r = R.rank_countries(c, 40)
    return r.select("country", "n_usable", "median_n", "capped", F.round("top5_share", 8).alias("top5_share"))


def _toy_booster() -> SC.Booster:
    t = {"left": np.array([1, -1, 3, -1, -1]), "right": np.array([2, -1, 4, -1, -1]), "feature": np.array([0, 0, 1, 0, 0]), "at": np.array([10.0, 0.5, 1000.0, -0.25, 0.75], np.float32), "default_left": np.array([True, False, False, False, False]), "gain": np.array([3.0, 0, 1.0, 0, 0])}
    return SC.Booster(["bio_1", "bio_12"], 0.0, [t, {**t, "at": np.array([20.0, -0.125, 500.0, 0.5, 0.25], np.float32), "default_left": np.array([False, False, True, False, False])}])


def _scores(s, d):
    model = SC.Booster.from_json(_toy_booster().to_json())  # as it was saved
    out = SC.score(cells(s, d), model, ["bio_1", "bio_12"])
    return out.select("cell_id", F.round("p", 6).alias("p"))


_SCORE_SQL = _CELLS + ", m as (select cell_id, (case when bio_1 is null or bio_1 < 10 then 0.5 when bio_12 is not null and bio_12 < 1000 then -0.25 else 0.75 end) + (case when bio_1 < 20 then -0.125 when bio_12 is null or bio_12 < 500 then 0.5 else 0.25 end) z from cells) select cell_id, round(1 / (1 + exp(-z)), 6) as p from m"


def _toy_network() -> SC.Network:
    a = lambda *v: np.array(v, float)
    return SC.Network(["bio_1", "bio_12"], a(10, 1000), a(5, 500), (a([0.5, -0.25], [0.125, 1.0]), a(0.1, -0.2)), [(a([1.0, 0.5], [-0.5, 0.25]), a(0.05, 0.3))], (a([0.75, -1.0], [0.5, 0.25]), a(0.2, -0.1)), ["warm", "wet"], a(0.4, -0.3))


def _network(s, d):
    """A saved network scored in batches."""
    net = SC.Network.from_json(_toy_network().to_json())
    p = SC.score(cells(s, d), net, ["bio_1", "bio_12"])
    return p.select("cell_id", *[F.round(F.get("p", i), 8).alias(n) for i, n in enumerate(net.species)])


_NETWORK_SQL = _CELLS + """, z as (select cell_id, coalesce((bio_1 - 10) / 5, 0) a, coalesce((bio_12 - 1000) / 500, 0) b from cells),
h as (select cell_id, 0.5 * a + 0.125 * b + 0.1 a, -0.25 * a + b - 0.2 b from z),
r as (select cell_id, a + greatest(a - 0.5 * b + 0.05, 0) a, b + greatest(0.5 * a + 0.25 * b + 0.3, 0) b from h)
select cell_id, round(1 / (1 + exp(-(0.75 * a + 0.5 * b + 0.2 - 0.4))), 8) as warm, round(1 / (1 + exp(-(-a + 0.25 * b - 0.1 + 0.3))), 8) as wet from r"""


def _gbt(s, d):
    c = cells(s, d).dropna(subset=["bio_1", "bio_12"]).withColumn("y", (F.col("bio_1") > 15).cast("int"))
    m = SC.train_gbt(c, ["bio_1", "bio_12"], rounds=5)
    return s.createDataFrame([(f, float(v)) for f, v in zip(["bio_1", "bio_12"], m.featureImportances.toArray())], "feature string, share double")


QUERIES = {
    "score_notes": (_notes, _NOTES_SQL),
    "top_picks": (lambda s, d: R.top_picks(R.gated(_sc(s, d)).where("auc is not null")).select("site", "species", "rank"), _SC + ", r as (select site, species, cast(row_number() over (partition by site order by p * auc desc, seq) as int) as rank from sc where p >= 0.3 and auc is not null and not avoid) select * from r where rank <= 5"),
    "avoid_list": (lambda s, d: R.avoid_list(R.gated(_sc(s, d))).select("site", "species", "rank"), _SC + ", r as (select site, species, cast(row_number() over (partition by site order by p desc, seq) as int) as rank from sc where p >= 0.3 and avoid) select * from r where rank <= 8"),
    "quota_rank": (_quota, _QUOTA_SQL),
    "site_filter": (_site, _SITE_SQL),
    "traits": (_traits_out, "with t as (select p_partkey k, ['Acer', 'Quercus', 'Tilia', 'Ulmus'][p_partkey % 4 + 1] g, p_brand b from part) select k as p_partkey, k % 13 = 0 or k % 17 = 0 as avoid, k % 3 = 0 and k % 3 <> 0 or (k % 3 = 0 and ['full', 'part', 'shade'][k % 3 + 1] <> 'full') as fits, case when g = 'Acer' then concat(upper(substr(b, 1, 1)), lower(substr(b, 2)), ' Maple') when g = 'Quercus' then concat(upper(substr(b, 1, 1)), lower(substr(b, 2)), ' Oak') else concat(g, ' ', b) end as common_name, case when k % 13 = 0 and k % 2 = 0 then 'invasive' when k % 2 = 1 then 'native' else 'introduced' end as origin, case when k % 2 = 0 then 'Europe' end as region from t"),
    "importance": (_importance, "with l as (select concat('s', cast(l_suppkey % 12 as varchar)) species, cast(l_partkey % 40 as varchar) feature, sum(cast(l_quantity as double)) gain from lineitem group by 1, 2), s as (select *, gain / sum(gain) over (partition by species) share from l), r as (select species, feature, share, cast(row_number() over (partition by species order by share desc, feature) as int) as rank from s) select species, feature, round(share, 8) as share, rank from r where rank <= 5 and share >= 0.01"),
    "saved_models": (lambda s, d: T.saved_models(*_models(s, d)).select("species"), _SC + " select species from sc where seq % 5 <> 0 and auc >= 0.7 and seq % 7 <> 0"),
    "work_list": (lambda s, d: R.work_list(_sc(s, d).select("species"), *_models(s, d)), _SC + " select species from sc where not (seq % 5 <> 0 and seq % 7 <> 0)"),
    "discover_runs": (_runs, "with r as (select s_suppkey % 8 country, s_suppkey k, s_name as path, row_number() over (partition by s_suppkey % 8 order by s_suppkey % 2, cast(s_suppkey % 3 = 1 as int) desc, (s_suppkey * 7) % 50 desc, s_suppkey desc, s_name) j from supplier) select country, path from r where j = 1"),
    "incomplete_checkpoints": (_incomplete, "with n as (select o_custkey % 100 species, count(*) n from orders group by 1), m as (select i species, case when i % 3 = 0 then 150 when i >= 100 then 0 else i end claimed from range(10, 110) r(i)), j as (select species, coalesce(n, 0) n_rows, claimed from n full outer join m using (species)) select species, n_rows, claimed, case when claimed is null then 'no meta' when n_rows = 0 then 'empty' else 'rows differ' end as reason from j where claimed is null or n_rows = 0 or n_rows <> claimed"),
    "rank_countries": (_countries, "with c as (select o_custkey % 7 country, o_orderkey % 60 species, count(*) n from orders group by 1, 2), k as (select *, row_number() over (partition by country order by n desc, species) k from c) select country, count(*) filter (n >= 30) as n_usable, median(n) as median_n, cast(sum(least(n, 40)) as bigint) as capped, round(cast(sum(n) filter (k <= 5) as double) / sum(n), 8) as top5_share from k group by 1"),
    "booster_scores": (_scores, _SCORE_SQL),
    "network_scores": (_network, _NETWORK_SQL),
    "gbt_importance": (_gbt, None),
    "weighted_key": (lambda s, d: cells(s, d).select("cell_id", F.round(S.weighted_key(S.hashed_uniform(F.col("cell_id")), F.col("tree")), 8).alias("key")), _CELLS + f" select cell_id, case when tree > 0 then round(-ln({S.hashed_uniform_sql('cell_id')}) / tree, 8) end as key from cells"),
}

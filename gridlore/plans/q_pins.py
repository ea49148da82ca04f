"""The query of recommendations at pins, with its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.grid import GLOBAL_10M
from ..operators.recommend import CONFIDENCE
from ..operators.score import Booster
from ..sources.tables import CELLS_SQL, OCC_SQL, cells, view
from . import pins

_FEATURES = ["bio_1", "bio_12"]
_ENVELOPE = (-100.0, 30.0, -95.5, 34.5)


def _stump(feature: int, at: float, left: float, right: float, missing_left: bool) -> Booster:
    ends = lambda *v: np.array(v)
    return Booster(_FEATURES, 0.0, [{"left": ends(1, -1, -1), "right": ends(2, -1, -1), "feature": ends(feature, 0, 0), "at": np.array([at, left, right], np.float32), "default_left": ends(missing_left, False, False), "gain": ends(1.0, 0.0, 0.0)}])


_MODELS = {"acer": _stump(0, 15.0, 1.25, -0.25, False), "quercus": _stump(1, 1000.0, -0.5, 2.0, True), "tilia": _stump(0, 25.0, 0.5, -2.0, True)}


def _inputs(s, d):
    sites = view(s, d, "customer").select(
        F.col("c_custkey").alias("site"),
        (F.lit(29.5) + F.col("c_custkey") % 600 / 100.0).alias("latitude"),
        (F.lit(-100.5) + F.col("c_custkey") * 7 % 600 / 100.0).alias("longitude"),
    )
    traits = s.createDataFrame(
        [("acer", 0, 0.875, 5, ["shade"], "full", False), ("quercus", 1, 0.75, 4, ["shade", "fruit"], "part", False), ("tilia", 2, 0.8125, 3, ["shade"], "full", True)],
        "species string, seq int, auc double, n_folds int, goals array<string>, sun string, avoid boolean",
    )
    later = cells(s, d).withColumn("bio_1_later", F.when(F.col("tree").isNotNull(), F.col("bio_1") + 8))
    return sites, later, traits


def _lists(s, d, refused=False):
    sites, later, traits = _inputs(s, d)
    out = pins.recommend(sites, later, GLOBAL_10M, _MODELS, traits, _FEATURES, {"bio_1": "bio_1_later"}, _ENVELOPE, ["bio_1"], 0, "shade", None, 1, 8)
    return out[1] if refused else out[0].select("site", "list", "rank", "species", F.round("p", 6).alias("p"), F.round("p_later", 6).alias("p_later"), "note", "confidence")


_AT = f"""with occ as ({OCC_SQL.format(events='events')}), cells as ({CELLS_SQL.format(occ='occ')}),
pins as (select c_custkey as site, 29.5 + (c_custkey % 600) / 100.0 as latitude, -100.5 + (c_custkey * 7 % 600) / 100.0 as longitude from customer),
placed as (
  select *, cast(floor((latitude - 90.0) / (-1.0 / 6.0)) as int) as r, cast(floor((longitude + 180.0) / (1.0 / 6.0)) as int) as c,
    latitude between 30.0 and 34.5 and longitude between -100.0 and -95.5 as inside
  from pins),
sampled as (
  select p.site, p.inside, bio_1, bio_12, case when tree is not null then bio_1 + 8 end as bio_1_later
  from placed p left join cells on grid_row = p.r and grid_col = p.c),
problems as (
  select *, case when not inside then 'outside of the area' when bio_1 is null then 'needed layer missing' when bio_12 is null then 'too many layers missing' end as problem
  from sampled)"""

_SIGMOID = "1 / (1 + exp(-({})))"
_ACER, _TILIA = "case when {0} < 15 then 1.25 else -0.25 end", "case when {0} < 25 then 0.5 else -2.0 end"
_QUERCUS = "case when bio_12 < 1000 then -0.5 else 2.0 end"
_LISTS_SQL = _AT + f""",
scored as (
  select site, 'acer' as species, 0 as seq, 0.875 as auc, 5 as folds, false as avoid, {_SIGMOID.format(_ACER.format("bio_1"))} as p,
    case when bio_1_later is not null then {_SIGMOID.format(_ACER.format("bio_1_later"))} end as p_later from problems where problem is null
  union all select site, 'quercus', 1, 0.75, 4, false, {_SIGMOID.format(_QUERCUS)}, case when bio_1_later is not null then {_SIGMOID.format(_QUERCUS)} end from problems where problem is null
  union all select site, 'tilia', 2, 0.8125, 3, true, {_SIGMOID.format(_TILIA.format("bio_1"))},
    case when bio_1_later is not null then {_SIGMOID.format(_TILIA.format("bio_1_later"))} end from problems where problem is null),
gated as (
  select *, p_later - p as d,
    case when p >= 0.70 and auc >= 0.85 and folds >= 4 then '{CONFIDENCE[0]}' when p >= 0.50 and auc >= 0.75 then '{CONFIDENCE[1]}' else '{CONFIDENCE[2]}' end as confidence
  from scored where p >= 0.30),
ranked as (
  select *, case when avoid then 'avoid' else 'picks' end as list,
    cast(row_number() over (partition by site, avoid order by case when avoid then p else p * auc end desc, seq) as int) as rank
  from gated)
select site, list, rank, species, round(p, 6) as p, round(p_later, 6) as p_later,
  case when p_later is null or (p_later >= 0.70 and d >= -0.05) then ''
       when d <= -0.15 then concat('Record-likeness drops ', cast(cast(round_even(-d * 100, 0) as int) as varchar), '% under 2050 BIO.')
       when d >= 0.10 then concat('Record-likeness rises ', cast(cast(round_even(d * 100, 0) as int) as varchar), '% under 2050 BIO.') else '' end as note,
  confidence
from ranked where rank <= case when avoid then 8 else 1 end"""

QUERIES = {
    "pin_recommendation": (_lists, _LISTS_SQL),
    "pins_refused": (lambda s, d: _lists(s, d, refused=True), _AT + " select site, problem from problems where problem is not null"),
}

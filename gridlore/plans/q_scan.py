"""Queries of polygons over cells, clips, area averages and training over partitions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.grid import Grid
from ..operators import ablation, deepnet, metrics, polygons, training, warp
from ..operators.score import score
from ..sources.tables import cells, view
from ..sources.work import work_path

_GRID = Grid("scan", 60, 50, 0.0, 0.5, 25.0, -0.5)
# A star with a hole, in eighths of a degree around a supplier's point: fixed corners, outline and hole.
_OUTLINE = [(0, 21), (5, 7), (19, 5), (9, -4), (13, -21), (0, -11), (-13, -17), (-9, -3), (-21, 6), (-5, 8)]
_HOLE = [(-2, -3), (3, -2), (1, 4)]
_CORNERS = [(r, i, x, y) for r, ring in enumerate((_OUTLINE, _HOLE)) for i, (x, y) in enumerate(ring)]


def _vertices(s, d):
    """A polygon for each supplier; some reach beyond the grid."""
    k = F.col("s_suppkey")
    corners = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(c, ("ring", "seq", "x", "y")))) for c in _CORNERS))
    scale = (k % 3 + 1) / 8
    at = view(s, d, "supplier").select(k.alias("shape"), (k * 7 % 31 + 1 / 16).alias("cx"), (k * 5 % 27 - 1 + 1 / 32).alias("cy"), scale.alias("scale"), F.explode(corners).alias("p"))
    return at.select("shape", "p.ring", "p.seq", (F.col("cx") + F.col("p.x") * F.col("scale")).alias("x"), (F.col("cy") + F.col("p.y") * F.col("scale")).alias("y"))


_VALUES = ", ".join(f"({r}, {i}, {x}, {y})" for r, i, x, y in _CORNERS)
_EDGES = f"""p(ring, seq, x, y) as (values {_VALUES}),
w as (
  select s_suppkey as shape, ring, seq, ((s_suppkey * 7 % 31 + 0.0625 :: double) + x * ((s_suppkey % 3 + 1) / 8.0 :: double)) / 0.5 as u1, (((s_suppkey * 5 % 27 - 1 + 0.03125 :: double) + y * ((s_suppkey % 3 + 1) / 8.0 :: double)) - 25.0) / -0.5 as v1
  from supplier, p),
e as (
  select shape, u1, v1, coalesce(lead(u1) over r, first_value(u1) over r) as u2, coalesce(lead(v1) over r, first_value(v1) over r) as v2
  from w window r as (partition by shape, ring order by seq)),
g as (select r.r as grid_row, c.c as grid_col from (select unnest(range(50)) as r) r, (select unnest(range(60)) as c) c),
inside as (
  select shape, grid_row, grid_col from g join e on (v1 <= grid_row + 0.5) <> (v2 <= grid_row + 0.5) and u1 + (grid_row + 0.5 - v1) * (u2 - u1) / (v2 - v1) <= grid_col + 0.5
  group by all having count(*) % 2 = 1),
o as (
  select shape, grid_row, u1 + (greatest(least(v1, grid_row + 1), grid_row) - v1) * (u2 - u1) / (v2 - v1) as a, u1 + (greatest(least(v2, grid_row + 1), grid_row) - v1) * (u2 - u1) / (v2 - v1) as b
  from e join (select unnest(range(50)) as grid_row) r on grid_row between floor(least(v1, v2)) and floor(greatest(v1, v2)) where v1 <> v2
  union all select shape, cast(floor(v1) as int), u1, u2 from e where v1 = v2),
outline as (select distinct shape, o.grid_row, g.grid_col from o join g on g.grid_row = o.grid_row and g.grid_col between floor(least(a, b)) and floor(greatest(a, b)))"""


def _covered(s, d):
    v = _vertices(s, d)
    inside = polygons.covered_cells(v, _GRID, all_touched=False).withColumn("inside", F.lit(1))
    both = polygons.covered_cells(v, _GRID).join(inside, ["shape", "grid_row", "grid_col"], "left")
    return both.groupBy("shape").agg(F.count("*").alias("touched"), F.count("inside").alias("inside"), F.sum(F.col("grid_row") * 60 + F.col("grid_col")).alias("cells"))


_COVERED_SQL = f"""with {_EDGES},
t as (select shape, grid_row, grid_col, max(k) as k from (select *, 1 as k from inside union all select *, 0 from outline) group by 1, 2, 3)
select shape, count(*) as touched, sum(k) :: bigint as inside, sum(grid_row * 60 + grid_col) :: bigint as cells from t group by 1"""


def _clip(s, d):
    """Customers' cells on a larger lattice, cut to shapes of the smaller."""
    large = Grid("large", 80, 70, -5.0, 0.5, 30.0, -0.5)
    i = F.col("c_custkey")
    on = view(s, d, "customer").select(F.floor(i / 80).cast("int").alias("grid_row"), (i % 80).cast("int").alias("grid_col"), F.col("c_acctbal").cast("double").alias("v"))
    own = polygons.clip_to_shape(on, _vertices(s, d), _GRID, large)
    return own.groupBy("shape").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"))


_CLIP_SQL = f"""with {_EDGES},
t as (select shape, grid_row, grid_col from inside union select * from outline),
c as (select c_custkey // 80 - 10 as grid_row, c_custkey % 80 - 10 as grid_col, cast(c_acctbal as double) as v from customer)
select shape, count(*) as n, round(sum(v), 2) as total from t join c using (grid_row, grid_col) group by 1"""


def _average(s, d):
    i = F.col("c_custkey")
    source, target = Grid("source", 40, 50, 0.0, 0.25, 20.0, -0.25), Grid("target", 12, 9, 0.5, 0.6, 19.75, -0.7)
    on = view(s, d, "customer").select(F.floor(i / 40).cast("int").alias("grid_row"), (i % 40).cast("int").alias("grid_col"), F.when(i % 7 > 0, F.col("c_acctbal").cast("double")).alias("v"))
    return warp.area_average(on, source, target, ["v"]).select("grid_row", "grid_col", F.round("v", 5).alias("v"), F.round("share", 6).alias("share"))


_AVERAGE_SQL = """with c as (select c_custkey // 40 as r, c_custkey % 40 as k, case when c_custkey % 7 > 0 then cast(c_acctbal as double) end as v from customer),
b as (select *, (20.0 - r * 0.25 - 19.75) / -0.7 as v0, (20.0 - (r + 1) * 0.25 - 19.75) / -0.7 as v1, (k * 0.25 - 0.5) / 0.6 as u0, ((k + 1) * 0.25 - 0.5) / 0.6 as u1 from c),
t as (select r.r as grid_row, k.k as grid_col from (select unnest(range(9)) as r) r, (select unnest(range(12)) as k) k),
o as (
  select t.grid_row, t.grid_col, b.v, (least(v1, grid_row + 1) - greatest(v0, grid_row)) * (least(u1, grid_col + 1) - greatest(u0, grid_col)) as w
  from b join t on v0 < grid_row + 1 and v1 > grid_row and u0 < grid_col + 1 and u1 > grid_col)
select cast(grid_row as int) as grid_row, cast(grid_col as int) as grid_col, round(sum(v * w) / sum(w) filter (v is not null), 5) as v, round(sum(w), 6) as share from o where w > 1e-12 group by 1, 2"""


def _network(s, d):
    """Three species by hashed presence on all cells, learnt over partitions, then scored."""
    c = cells(s, d).withColumns({f"sp{k}": F.when(F.col("bio_12") % (7 + 4 * k) < 3, 1).otherwise(0) for k in range(3)})
    net = deepnet.fit_network(c, ["bio_1", "bio_12", "tree"], ["sp0", "sp1", "sp2"], hidden=8, epochs=6)
    return score(c, net, ["bio_1", "bio_12", "tree"], "suitability", ["cell_id"])


def _ablation(s, d):
    """Two feature sets on three made species over all cells, paired by stratum, fold and species: metrics only, as trees can't be trained in SQL."""
    c = cells(s, d).withColumns({"fold": (F.floor(F.col("cell_id") / 40) % 5).cast("int"), "tree_pct": F.col("tree") * 100, "crop_pct": F.lit(60.0) - F.col("tree") * 60})
    y = F.when(F.col("species") == 0, F.col("bio_1") > 15).when(F.col("species") == 1, F.col("bio_12") > 1200).otherwise(F.col("tree") > 0.5)
    rows = c.withColumn("species", F.explode(F.array(*map(F.lit, range(3))))).withColumn("y", F.coalesce(y, F.lit(False)).cast("int"))
    arms = {"env": ["bio_1", "bio_12"], "env_satellite": ["bio_1", "bio_12", "tree"]}
    found = ablation.run(rows, arms, work_path(s, "ablation"), batches=2, rounds=15, s=training.Settings(depth=3))
    return metrics.paired_deltas(found.where("stratum is not null"), "env", ["auc", "tss"])


QUERIES = {
    "covered_cells": (_covered, _COVERED_SQL),
    "clip_to_shape": (_clip, _CLIP_SQL),
    "area_average": (_average, _AVERAGE_SQL),
    "network_over_partitions": (_network, None),
    "ablation_runs": (_ablation, None),
}

"""Queries of model metrics and folds, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds as FO
from ..operators import metrics as M
from ..sources.tables import CELLS_SQL, OCC_SQL, cells, occ, view

_FS_SQL = "select l_orderkey * 10 + l_linenumber as rid, cast(l_suppkey % 12 as int) as sp, case when l_returnflag = 'R' then 1 else 0 end as y, cast(l_orderkey % 5 as int) as fold, floor(l_extendedprice / 500) / 256 as score, cast(l_linenumber % 3 > 0 as int) as mask from {t}"
_FS = f"with fs as ({_FS_SQL.format(t='lineitem')})"
_OCC = f"with occ as ({OCC_SQL.format(events='events')})"
_CELLS = _OCC + f", cells as ({CELLS_SQL.format(occ='occ')})"


def _fs(s, d):
    l = view(s, d, "lineitem")
    return l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rid"), (F.col("l_suppkey") % 12).cast("int").alias("sp"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_orderkey") % 5).cast("int").alias("fold"), (F.floor(F.col("l_extendedprice") / 500) / 256.0).alias("score"), (F.col("l_linenumber") % 3 > 0).cast("int").alias("mask"))


def _r(df, *cols, n=8):
    return df.withColumns({c: F.round(c, n) for c in cols})


_AUC = ", r as (select *, rank() over (partition by {k} order by score) + (count(*) over (partition by {k}, score) - 1) / 2.0 rk from fs), a as (select {k}, cast(sum(y) as bigint) n_pos, cast(count(*) - sum(y) as bigint) n_neg, (sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) auc from r group by {k})"
_TSS = ", g as (select sp, score, sum(y) p, count(*) - sum(y) n from fs group by 1, 2), t as (select *, cast(sum(p) over (partition by sp order by score desc) as double) / sum(p) over (partition by sp) - cast(sum(n) over (partition by sp order by score desc) as double) / sum(n) over (partition by sp) tss from g), b as (select *, row_number() over (partition by sp order by tss desc, score desc) k from t)"
_BOYCE = _FS + """, lim as (select sp, min(case when y = 0 then score end) lo, max(case when y = 0 then score end) hi, sum(y) np, count(*) - sum(y) nn from fs group by 1),
w as (select lim.*, k, (hi - lo) * 0.1 span, lo + k * ((hi - (hi - lo) * 0.1 - lo) / 100) st from lim, range(101) r(k)),
x as (select w.sp, w.k, any_value(st + span / 2) mid, cast(sum(y) as double) / any_value(np) p, cast(count(*) - sum(y) as double) / any_value(nn) e from w join fs on fs.sp = w.sp and fs.score >= st and fs.score <= st + span group by 1, 2),
q as (select sp, mid, p / e ratio from x where e > 0), rk as (select sp, rank() over (partition by sp order by mid) + (count(*) over (partition by sp, mid) - 1) / 2.0 ra, rank() over (partition by sp order by ratio) + (count(*) over (partition by sp, ratio) - 1) / 2.0 rb from q)
select sp, round(case when count(*) >= 3 then corr(ra, rb) end, 6) as boyce from rk group by 1"""


def _runs(s, d):
    f = _fs(s, d)
    arms = [M.auc(f.withColumn("score", F.pmod(F.col("score") * m, F.lit(7.0))).withColumnRenamed("sp", "species"), ["fold", "species"]).select(F.lit(n).alias("feature_set"), F.lit("all").alias("stratum"), "fold", "species", "auc", (F.col("auc") / 2).alias("tss")) for n, m in (("env", 1.0), ("env_satellite", 3.0))]
    return arms[0].unionByName(arms[1])


_RUNS = _FS + ", " + ", ".join(f"r{i} as (select *, rank() over (partition by fold, sp order by fmod(score * {m}, 7)) + (count(*) over (partition by fold, sp, fmod(score * {m}, 7)) - 1) / 2.0 rk from fs), a{i} as (select fold, sp, (sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) auc from r{i} group by 1, 2)" for i, m in ((1, "1.0"), (2, "3.0")))


def _ref_pct(s, d):
    f = _fs(s, d)
    return M.reference_percentile(f.select("rid", "sp", "score"), f.where("y = 0").select("sp", "score"), "sp").select("rid", F.round("percentile", 8).alias("percentile"))


def _cv(s, d):
    a = M.auc(_fs(s, d), ["fold", "sp"]).withColumn("n_trees", (F.col("n_pos") % 40 + 1))
    return _r(M.cv_summary(a, ["sp"]), "auc")


def _status(s, d):
    c = view(s, d, "customer")
    k = F.col("c_custkey")
    st = M.status(F.when(k % 17 == 0, 0).otherwise(k % 400), k % 400, F.when(k % 13 == 0, 0).otherwise(k), k % 19 == 0, k % 6)
    return c.select("c_custkey", st.alias("status"))


def _scaled(s, d):
    c, cols = cells(s, d), ["bio_1", "bio_12"]
    z = M.scale(c, M.scaler(c.where("cell_id % 2 = 0"), cols), cols)
    return _r(z.select("cell_id", *cols), *cols)


_SC = ", f as (select median(bio_1) m1, avg(bio_1) a1, stddev_pop(bio_1) s1, median(bio_12) m2, avg(bio_12) a2, stddev_pop(bio_12) s2 from cells where cell_id % 2 = 0)"


def _fold_eval(s, d):
    f = _fs(s, d).withColumnRenamed("sp", "species")
    th = M.max_tss(f.where("fold <> 4").withColumn("fold", F.lit(4)), ["fold", "species"]).where("species <> 3")
    e = M.fold_evaluation(f.where("fold <> 4").withColumn("fold", F.lit(4)), f.where("fold = 4"), th)
    return _r(e, "auc", "boyce", "sensitivity", "specificity", "tss", "omission_rate", n=6)


def _assigned(s, d):
    o = occ(s, d).where("latitude is not null").withColumn("block", FO.block_of(F.col("latitude"), F.col("longitude"), 1.0))
    return FO.fold_sizes(FO.assign_folds(o))


_GREEDY_SQL = _OCC.replace("with occ", "with recursive occ", 1) + """,
b as (select cast(floor(latitude + 90) as bigint) * 360 + cast(floor(longitude + 180) as bigint) as block, count(*) as n from occ where latitude is not null group by 1),
o as (select *, row_number() over (order by n desc, block) as k, least(5, count(*) over ()) as folds from b),
w as (
  select cast(0 as bigint) as k, cast(null as bigint) as block, cast(0 as bigint) as n, cast(null as bigint) as fold, list_transform(range(cast((select max(folds) from o) as bigint)), lambda x: cast(0 as bigint)) as load
  union all
  select o.k, o.block, o.n, list_position(load, list_min(load)) - 1, list_transform(load, lambda x, i: x + case when i = list_position(load, list_min(load)) then o.n else 0 end)
  from w join o on o.k = w.k + 1)
select cast(fold as int) as fold, cast(sum(n) as bigint) as n, count(*) as n_blocks from w where k > 0 group by 1"""


QUERIES = {
    "average_ranks": (lambda s, d: M.average_ranks(_fs(s, d), ["sp"], "score").select("rid", "avg_rank"), _FS + " select rid, cast(rank() over (partition by sp order by score) + (count(*) over (partition by sp, score) - 1) / 2.0 as double) as avg_rank from fs"),
    "auc_by_species": (lambda s, d: _r(M.auc(_fs(s, d), ["sp"]), "auc"), _FS + _AUC.format(k="sp") + " select sp, n_pos, n_neg, round(auc, 8) as auc from a"),
    "auc_by_fold": (lambda s, d: _r(M.auc(_fs(s, d), ["fold", "sp"]), "auc"), _FS + _AUC.format(k="fold, sp") + " select fold, sp, n_pos, n_neg, round(auc, 8) as auc from a"),
    "auc_ordinal": (lambda s, d: _r(M.auc_ordinal(_fs(s, d), ["sp"]), "auc"), _FS + ", r as (select *, row_number() over (partition by sp order by score, rid) rk from fs), a as (select sp, cast(sum(mask * y) as double) n_pos, cast(sum(mask * (1 - y)) as double) n_neg, sum(case when mask * y = 1 then rk end) s from r group by 1) select sp, n_pos, round((s - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg), 8) as auc from a"),
    "confusion": (lambda s, d: _r(M.confusion(_fs(s, d), ["sp"], F.lit(0.4)), "sensitivity", "specificity", "tss", "omission_rate"), _FS + ", a as (select sp, count(*) filter (score >= 0.4 and y = 1) tp, count(*) filter (score < 0.4 and y = 1) fn, count(*) filter (score < 0.4 and y = 0) tn, count(*) filter (score >= 0.4 and y = 0) fp from fs group by 1), b as (select *, cast(tp as double) / (tp + fn) se, cast(tn as double) / (tn + fp) spc from a) select sp, tp, fn, tn, fp, round(se, 8) as sensitivity, round(spc, 8) as specificity, round(se + spc - 1, 8) as tss, round(1 - se, 8) as omission_rate from b"),
    "max_tss": (lambda s, d: _r(M.max_tss(_fs(s, d), ["sp"]), "tss_max"), _FS + _TSS + " select sp, round(tss, 8) as tss_max, score as threshold from b where k = 1"),
    "boyce": (lambda s, d: _r(M.boyce(_fs(s, d), ["sp"]), "boyce", n=6), _BOYCE),
    "tenth_percentile": (lambda s, d: _r(M.tenth_percentile(_fs(s, d), ["sp"]), "p10"), _FS + " select sp, round(quantile_cont(score, 0.1), 8) as p10 from fs where y = 1 group by 1"),
    "reference_percentile": (_ref_pct, _FS + ", g as (select sp, score, sum(1 - y) c from fs group by 1, 2), "
    "p as (select sp, score, coalesce(sum(c) over (partition by sp order by score rows between unbounded preceding and 1 preceding), 0) * 100.0 / sum(c) over (partition by sp) pct from g) "
    "select rid, round(pct, 8) as percentile from fs join p using (sp, score)"),
    "cv_summary": (_cv, _FS + _AUC.format(k="fold, sp") + " select sp, round(avg(auc), 8) as auc, count(auc) as n_folds_usable, count(*) as n_folds, cast(greatest(floor(median(n_pos % 40 + 1)), 10) as int) as n_trees from a group by 1"),
    "status": (_status, "with a as (select c_custkey k from customer) select k as c_custkey, case when k % 17 = 0 or k % 400 = 0 then 'skip_no_records' when k % 400 < 150 then 'skip_few_cells' when k % 13 = 0 then 'skip_no_background' when k % 19 = 0 then 'skip_train_error' when k % 6 = 0 then 'skip_no_folds' when k % 6 < 3 then 'skip_few_folds' else 'saved' end as status from a"),
    "feature_scaler": (_scaled, _CELLS + _SC + " select cell_id, round(greatest(least((coalesce(bio_1, m1) - a1) / s1, 5), -5), 8) as bio_1, round(greatest(least((coalesce(bio_12, m2) - a2) / s2, 5), -5), 8) as bio_12 from cells, f"),
    "log_normaliser": (lambda s, d: _r(M.log_normaliser(_fs(s, d), "sp", "score"), "log_z"), _FS + " select sp, round(ln(sum(exp(score))) - ln(count(*)), 8) as log_z from fs group by 1"),
    "positive_weight": (lambda s, d: _r(M.positive_weight(_fs(s, d), "sp"), "ratio", "weight"), _FS + ", a as (select sp, cast(count(*) - sum(y) as double) / sum(y) r from fs group by 1) select sp, round(r, 8) as ratio, round(greatest(least(r, 50), 1), 8) as weight from a"),
    "paired_deltas": (lambda s, d: _r(M.paired_deltas(_runs(s, d), "env", ["auc", "tss"]), "mean_delta", "sd_delta", "share_improved"), _RUNS + ", d as (select 'auc' m, a2.auc - a1.auc d from a1 join a2 using (fold, sp) union all select 'tss', a2.auc / 2 - a1.auc / 2 from a1 join a2 using (fold, sp)) select 'env_satellite' as feature_set, 'all' as stratum, m as metric, round(avg(d), 8) as mean_delta, round(stddev_samp(d), 8) as sd_delta, round(avg(cast(d > 0 as int)), 8) as share_improved, count(*) as n from d where d is not null group by m"),
    "ablation_verdict": (lambda s, d: _r(M.verdict(M.paired_deltas(_runs(s, d), "env", ["auc"])), "headline"), _RUNS + ", h as (select avg(a2.auc - a1.auc) v from a1 join a2 using (fold, sp)) select round(v, 8) as headline, case when v <= 0.005 then 'no advantage' else 'ambiguous' end as verdict from h"),
    "separation": (lambda s, d: _r(M.separation(cells(s, d).withColumn("y", (F.col("cell_id") % 3 == 0).cast("int")), ["bio_1", "bio_12"]), "presence_mean", "background_mean", "difference", "standardised", n=6), _CELLS + ", l as (select cell_id % 3 = 0 y, 'bio_1' layer, bio_1 v from cells union all select cell_id % 3 = 0, 'bio_12', bio_12 from cells), a as (select layer, avg(v) filter (y) p, avg(v) filter (not y) b, sqrt((var_pop(v) filter (y) + var_pop(v) filter (not y)) / 2) s from l group by 1) select layer, round(p, 6) as presence_mean, round(b, 6) as background_mean, round(p - b, 6) as difference, round((p - b) / s, 6) as standardised from a"),
    "direction_agreement": (lambda s, d: _r(M.direction_agreement(_fs(s, d).groupBy("sp", "fold").agg((F.avg(F.when(F.col("y") == 1, F.col("score"))) - F.avg(F.when(F.col("y") == 0, F.col("score")))).alias("difference")), "fold"), "agreement", "mean_abs"), _FS + ", e as (select sp, fold, avg(score) filter (y = 1) - avg(score) filter (y = 0) d from fs group by 1, 2) select fold, round(greatest(avg(cast(d > 0 as int)), 1 - avg(cast(d > 0 as int))), 8) as agreement, round(avg(abs(d)), 8) as mean_abs, count(*) as n_species from e group by 1"),
    "metric_report": (lambda s, d: _r(M.report(M.auc(_fs(s, d), ["fold", "sp"]).withColumnRenamed("n_pos", "n_presence"), ["auc"]), "mean", "median", "least", "most", "corr_size", n=6), _FS + _AUC.format(k="fold, sp") + " select 'auc' as metric, round(avg(auc), 6) as mean, round(median(auc), 6) as median, round(min(auc), 6) as least, round(max(auc), 6) as most, round(corr(auc, n_pos), 6) as corr_size from a"),
    "metric_terciles": (lambda s, d: _r(M.by_tercile(M.auc(_fs(s, d), ["fold", "sp"]), "auc", "n_pos"), "mean"), _FS + _AUC.format(k="fold, sp") + ", e as (select quantile_cont(n_pos, 0.33) lo, quantile_cont(n_pos, 0.67) hi from a) select case when n_pos <= lo then 1 when n_pos <= hi then 2 else 3 end as tercile, round(avg(auc), 8) as mean, count(*) as n from a, e group by 1"),
    "fold_evaluation": (_fold_eval, None),
    "grid_folds": (lambda s, d: occ(s, d).where("latitude is not null").select("rid", FO.grid_fold(F.col("latitude"), F.col("longitude")).alias("fold")), _OCC + " select rid, ((cast(floor(latitude / 10) as int) * 7 + cast(floor(longitude / 10) as int) * 13) % 5 + 5) % 5 as fold from occ where latitude is not null"),
    "greedy_folds": (_assigned, _GREEDY_SQL),
    "kmeans_blocks": (lambda s, d: FO.kmeans_blocks(occ(s, d).where("latitude is not null"), 8).groupBy("block").agg(F.count("*").alias("n")), None),
}

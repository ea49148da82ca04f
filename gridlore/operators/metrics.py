"""Model metrics by group: rank statistics, thresholds, calibration curves, scalers and comparisons of runs.

Rank statistics work on counts of distinct scores by group, run over in two levels, so no window holds a group's scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip
from .prefix import running_by_key


def _steps(df: DataFrame, keys: Sequence[str], score: str, y: str) -> DataFrame:
    """(keys, score, p, n): presences and others at each distinct score; null scores are left out."""
    pos = F.sum((F.col(y) > 0).cast("bigint"))
    return df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("score")).agg(pos.alias("p"), (F.count("*") - pos).alias("n"))


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str = "avg_rank") -> DataFrame:
    """Ranks with ties averaged, joined back by value."""
    c = running_by_key(df.groupBy(*keys, value).agg(F.count("*").alias("_c")), keys, value, ["_c"])
    r = c.select(*keys, value, (F.col("upto__c") - F.col("_c") + (F.col("_c") + 1) / 2).alias(out))
    return df.join(r, [*keys, value], "left")


def auc(df: DataFrame, keys: Sequence[str], score: str = "score", y: str = "y") -> DataFrame:
    """Probability that a presence outscores another row, ties half; null for one-class groups."""
    s = running_by_key(_steps(df, keys, score, y), keys, "score", ["n"])
    s = s.withColumn("won", F.col("p") * (F.col("upto_n") - F.col("n") + F.col("n") / 2))
    return s.groupBy(*keys).agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), F.sum("won").alias("_w")).select(*keys, "n_pos", "n_neg", F.try_divide("_w", F.col("n_pos").cast("double") * F.col("n_neg")).alias("auc"))


def auc_ordinal(df: DataFrame, keys: Sequence[str], score: str = "score", y: str = "y", mask: str = "mask", order: str = "rid") -> DataFrame:
    """The quick form for early stopping: ordinal ranks over all rows, only masked-in rows counted. A window holds the rows of one score."""
    tied = running_by_key(df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("_s")).agg(F.count("*").alias("_c")), keys, "_s", ["_c"])
    nulls = df.where(F.col(score).isNull()).groupBy(*keys).agg(F.count("*").alias("_n"))  # ranked first
    below = tied.join(nulls, [*keys], "left").select(*keys, F.col("_s").alias(score), (F.col("upto__c") - F.col("_c") + F.coalesce("_n", F.lit(0))).alias("_below"))
    r = df.join(below, [*keys, score], "left").withColumn("_r", F.coalesce("_below", F.lit(0)) + F.row_number().over(Window.partitionBy(*keys, score).orderBy(order)))
    pos = (F.col(mask) > 0) & (F.col(y) > 0)
    a = r.groupBy(*keys).agg(F.sum(pos.cast("double")).alias("n_pos"), F.sum(((F.col(mask) > 0) & (F.col(y) <= 0)).cast("double")).alias("n_neg"), F.sum(F.when(pos, F.col("_r"))).alias("_s"))
    return a.select(*keys, "n_pos", F.try_divide(F.col("_s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2, F.col("n_pos") * F.col("n_neg")).alias("auc"))


def confusion(df: DataFrame, keys: Sequence[str], threshold: Column, score: str = "score", y: str = "y") -> DataFrame:
    """Sensitivity, specificity, TSS and omission where rows at or over the threshold count as predicted."""
    hit, pos = F.col(score) >= threshold, F.col(y) > 0
    n = lambda c: F.sum(c.cast("bigint"))
    a = df.groupBy(*keys).agg(n(hit & pos).alias("tp"), n(~hit & pos).alias("fn"), n(~hit & ~pos).alias("tn"), n(hit & ~pos).alias("fp"))
    a = a.withColumns({"sensitivity": F.try_divide("tp", F.col("tp") + F.col("fn")), "specificity": F.try_divide("tn", F.col("tn") + F.col("fp"))})
    return a.withColumns({"tss": F.col("sensitivity") + F.col("specificity") - 1, "omission_rate": 1 - F.col("sensitivity")})


def max_tss(df: DataFrame, keys: Sequence[str], score: str = "score", y: str = "y") -> DataFrame:
    """The best TSS and its threshold: cut points between distinct scores from the top, the first (highest) of equal ones."""
    s = running_by_key(_steps(df, keys, score, y), keys, "score", ["p", "n"])
    over = lambda c: F.try_divide(F.col(f"all_{c}") - F.col(f"upto_{c}") + F.col(c), F.col(f"all_{c}"))  # noqa: E731  share at the score or above
    s = s.withColumn("tss", over("p") - over("n"))
    best = F.max(F.when(F.col("tss").isNotNull(), F.struct("tss", "score"))).alias("b")
    return s.groupBy(*keys).agg(best).select(*keys, F.col("b.tss").alias("tss_max"), F.col("b.score").alias("threshold"))


def boyce(df: DataFrame, keys: Sequence[str], score: str = "score", y: str = "y", windows: int = 101, width: float = 0.1) -> DataFrame:
    """Continuous Boyce index: rank correlation of the predicted-to-expected ratio with the windows' midpoints; null under three usable windows.

    Each distinct score is dealt to the windows that hold it by arithmetic on its position, not by a range join.
    """
    s = _steps(df, keys, score, y)
    lim = s.groupBy(*keys).agg(F.min(F.when(F.col("n") > 0, F.col("score"))).alias("_lo"), F.max(F.when(F.col("n") > 0, F.col("score"))).alias("_hi"), F.sum("p").alias("_np"), F.sum("n").alias("_nn"))
    lim = lim.where((F.col("_hi") > F.col("_lo")) & (F.col("_np") > 0) & (F.col("_nn") >= 2)).withColumn("_span", (F.col("_hi") - F.col("_lo")) * width)
    start = lambda k: F.col("_lo") + k * ((F.col("_hi") - F.col("_span") - F.col("_lo")) / (windows - 1))
    step = (F.col("_hi") - F.col("_span") - F.col("_lo")) / (windows - 1)
    first, last = F.floor((F.col("score") - F.col("_span") - F.col("_lo")) / step) - 1, F.ceil((F.col("score") - F.col("_lo")) / step) + 1
    w = s.join(lim, [*keys]).withColumns({"_a": F.greatest(first, F.lit(0)), "_b": F.least(last, F.lit(windows - 1))}).where("_a <= _b")
    w = w.withColumn("k", F.explode(F.sequence("_a", "_b"))).withColumn("_start", start(F.col("k"))).where((F.col("score") >= F.col("_start")) & (F.col("score") <= F.col("_start") + F.col("_span")))
    r = w.groupBy(*keys, "k").agg(F.first("_start").alias("_start"), F.first("_span").alias("_span"), (F.sum("p") / F.first("_np")).alias("_p"), (F.sum("n") / F.first("_nn")).alias("_e")).where("_e > 0")
    r = r.select(*keys, (F.col("_start") + F.col("_span") / 2).alias("mid"), (F.col("_p") / F.col("_e")).alias("ratio"))
    return spearman(r, keys, "mid", "ratio").select(*keys, F.when(F.col("n") >= 3, F.col("rho")).alias("boyce"))


def spearman(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Correlation of average ranks; null where one side doesn't vary."""
    w = lambda c: Window.partitionBy(*keys).orderBy(c)
    peers = lambda c: F.count("*").over(Window.partitionBy(*keys, c))
    rank = lambda c: F.rank().over(w(c)) + (peers(c) - 1) / 2
    r = df.withColumns({"_ra": rank(a), "_rb": rank(b)})
    var = F.var_pop("_ra") * F.var_pop("_rb")
    return r.groupBy(*keys).agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("_ra", "_rb"), F.sqrt(var)).alias("rho"))


def tenth_percentile(df: DataFrame, keys: Sequence[str], score: str = "score", y: str = "y") -> DataFrame:
    return df.where(F.col(y) > 0).groupBy(*keys).agg(F.percentile(score, F.lit(0.1)).alias("p10"))


def reference_percentile(scores: DataFrame, reference: DataFrame, key: str = "species", score: str = "score") -> DataFrame:
    """Share of the key's reference scores below each score, in percent.

    Both sides are merged by score and counted cumulatively: no pair of a score and a reference score is formed.
    """
    both = scores.select(key, F.col(score).alias("_s"), F.lit(0).alias("_r")).distinct().unionByName(reference.select(key, F.col(score).alias("_s"), F.lit(1).alias("_r")))
    per = running_by_key(both.groupBy(key, "_s").agg(F.sum("_r").alias("_c"), F.max(1 - F.col("_r")).alias("_asked")), [key], "_s", ["_c"])
    per = per.withColumn("percentile", F.try_divide(100.0 * (F.col("upto__c") - F.col("_c")), F.col("all__c"))).where("_asked = 1")
    return scores.join(per.select(key, F.col("_s").alias(score), "percentile"), [key, score], "left")


def cv_summary(fold_auc: DataFrame, keys: Sequence[str] = ("species",)) -> DataFrame:
    """Mean AUC of the folds that have one, their number, and the number of trees: the median's whole part, ten at least."""
    return fold_auc.groupBy(*keys).agg(F.avg("auc").alias("auc"), F.count("auc").alias("n_folds_usable"), F.count("*").alias("n_folds"), F.greatest(F.floor(F.median("n_trees")), F.lit(10)).cast("int").alias("n_trees"))


def status(n_records: Column, n_cells: Column, n_background: Column, failed: Column, n_usable: Column, least_cells: int = 150, least_folds: int = 3, is_tree: Column | None = None) -> Column:
    """The closed set of outcomes, in the order in which a run would meet them."""
    out = F.when(~is_tree, "skip_not_tree") if is_tree is not None else F.when(F.lit(False), "")
    return (
        out.when(F.coalesce(n_records, F.lit(0)) == 0, "skip_no_records")
        .when(n_cells < least_cells, "skip_few_cells")
        .when(F.coalesce(n_background, F.lit(0)) == 0, "skip_no_background")
        .when(failed, "skip_train_error")
        .when(n_usable == 0, "skip_no_folds")
        .when(n_usable < least_folds, "skip_few_folds")
        .otherwise("saved")
    )


def scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: median, mean and population deviation of each column, nulls left out; deviations under 1e-8 are 1."""
    agg = [x for c in columns for x in (F.median(c).alias(f"{c}_median"), F.avg(c).alias(f"{c}_mean"), F.when(F.stddev_pop(c) < 1e-8, 1.0).otherwise(F.stddev_pop(c)).alias(f"{c}_sd"))]
    return df.agg(*agg)


def scale(df: DataFrame, fitted: DataFrame, columns: Sequence[str], limit: float | None = 5.0, fill: bool = True) -> DataFrame:
    """(x - mean) / sd, clipped; missing values take the median, or zero after scaling without ``fill``."""
    j = df.join(F.broadcast(fitted))  # one row
    for c in columns:
        z = (F.coalesce(c, f"{c}_median") - F.col(f"{c}_mean")) / F.col(f"{c}_sd") if fill else F.coalesce((F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_sd"), F.lit(0.0))
        j = j.withColumn(c, clip(z, -limit, limit) if limit else z)
    return j.select(df.columns)


def log_normaliser(df: DataFrame, key: str, value: str) -> DataFrame:
    """logsumexp(value) - log(rows) by key."""
    top = df.groupBy(key).agg(F.max(value).alias("_m"))
    return df.join(top, key).groupBy(key).agg((F.ln(F.sum(F.exp(F.col(value) - F.col("_m")))) + F.first("_m") - F.ln(F.count(value))).alias("log_z"))


def positive_weight(df: DataFrame, key: str = "species", y: str = "y", low: float = 1.0, high: float = 50.0) -> DataFrame:
    """Others over presences: as it is, and clipped."""
    r = F.try_divide(F.sum((F.col(y) <= 0).cast("bigint")), F.sum((F.col(y) > 0).cast("bigint")))
    return df.groupBy(key).agg(r.alias("ratio")).withColumn("weight", clip(F.col("ratio"), low, high))


def paired_deltas(runs: DataFrame, reference: str, metrics: Sequence[str]) -> DataFrame:
    """Each arm against the reference arm on the same stratum, fold and species: mean, sample deviation, share improved, n."""
    keys = ["stratum", "fold", "species"]
    long = runs.select("feature_set", *keys, F.stack(F.lit(len(metrics)), *[x for m in metrics for x in (F.lit(m), F.col(m))]).alias("metric", "value"))
    ref = long.where(F.col("feature_set") == reference).select(*keys, "metric", F.col("value").alias("_ref"))
    d = long.where(F.col("feature_set") != reference).join(ref, [*keys, "metric"]).withColumn("d", F.col("value") - F.col("_ref")).where("d is not null")
    return d.groupBy("feature_set", "stratum", "metric").agg(F.avg("d").alias("mean_delta"), F.stddev_samp("d").alias("sd_delta"), F.avg((F.col("d") > 0).cast("double")).alias("share_improved"), F.count("*").alias("n"))


def verdict(deltas: DataFrame, arm: str = "env_satellite") -> DataFrame:
    """What the paired AUC differences say, one row: gone, kept or unclear away from the headline stratum."""
    a = deltas.where((F.col("feature_set") == arm) & (F.col("metric") == "auc"))
    other = F.col("stratum").isin("low_tree", "no_tree", "cropland")
    s = a.agg(F.max(F.when(F.col("stratum") == "all", F.col("mean_delta"))).alias("headline"), F.max(F.when(other, F.col("mean_delta"))).alias("_hi"), F.min(F.when(other, F.col("mean_delta"))).alias("_lo"))
    hi, lo = F.try_divide("_hi", "headline"), F.try_divide("_lo", "headline")
    return s.select("headline", F.when(F.col("headline") <= 0.005, "no advantage").when(hi < 0.35, "confirms").when(lo > 0.7, "refutes").otherwise("ambiguous").alias("verdict"))


def separation(df: DataFrame, columns: Sequence[str], presence: str = "y") -> DataFrame:
    """Presence and background means of each layer, their difference, and it over the pooled population deviation."""
    long = df.select(presence, F.stack(F.lit(len(columns)), *[x for c in columns for x in (F.lit(c), F.col(c))]).alias("layer", "v")).where("v is not null")
    of = lambda p: F.when(F.col(presence) == p, F.col("v"))
    a = long.groupBy("layer").agg(F.avg(of(1)).alias("presence_mean"), F.avg(of(0)).alias("background_mean"), F.sqrt((F.var_pop(of(1)) + F.var_pop(of(0))) / 2).alias("_s"), F.count(of(1)).alias("_p"), F.count(of(0)).alias("_b"))
    a = a.where("_p >= 2 and _b >= 2").withColumn("difference", F.col("presence_mean") - F.col("background_mean"))
    return a.select("layer", "presence_mean", "background_mean", "difference", F.try_divide("difference", "_s").alias("standardised"))


def direction_agreement(effects: DataFrame, key: str = "layer", value: str = "difference") -> DataFrame:
    """Of effects by species: the share of the majority sign and the mean size."""
    up = F.avg((F.col(value) > 0).cast("double"))
    return effects.groupBy(key).agg(F.greatest(up, 1 - up).alias("agreement"), F.avg(F.abs(value)).alias("mean_abs"), F.count("*").alias("n_species"))


def report(metrics: DataFrame, columns: Sequence[str], size: str = "n_presence") -> DataFrame:
    """A row for each metric: mean, median, extremes, correlation with the number of presences."""
    long = metrics.select(size, F.stack(F.lit(len(columns)), *[x for c in columns for x in (F.lit(c), F.col(c))]).alias("metric", "v")).where("v is not null")
    return long.groupBy("metric").agg(F.avg("v").alias("mean"), F.median("v").alias("median"), F.min("v").alias("least"), F.max("v").alias("most"), F.corr("v", F.col(size).cast("double")).alias("corr_size"))


def by_tercile(metrics: DataFrame, value: str, size: str = "n_presence") -> DataFrame:
    """Means by third of the size, edges at the 33rd and 67th percentile."""
    e = metrics.agg(F.percentile(size, F.array(F.lit(0.33), F.lit(0.67))).alias("_e"))
    t = metrics.join(F.broadcast(e)).withColumn("tercile", F.when(F.col(size) <= F.col("_e")[0], 1).when(F.col(size) <= F.col("_e")[1], 2).otherwise(3))
    return t.groupBy("tercile").agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def fold_evaluation(train: DataFrame, held: DataFrame, thresholds: DataFrame, least_train: int = 5, least_held: int = 5) -> DataFrame:
    """(fold, species) metrics of the held rows; groups with too few presences on either side are skipped; a species without a threshold uses 0.5."""
    keys = ["fold", "species"]
    nt = train.where("y > 0").groupBy(*keys).agg(F.count("*").alias("n_train_presence"))
    h = held.join(thresholds.select(*keys, "threshold"), keys, "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.5)))
    c = confusion(h, [*keys, "threshold"], F.col("threshold"))
    out = c.join(nt, keys, "left").join(auc(held, keys), keys, "left").join(boyce(held, keys), keys, "left")
    return out.where((F.coalesce("n_train_presence", F.lit(0)) >= least_train) & (F.col("n_pos") >= least_held)).select(*keys, "n_pos", "n_neg", "n_train_presence", "threshold", "auc", "boyce", "sensitivity", "specificity", "tss", "omission_rate")


def strata(df: DataFrame, tree: str = "tree_pct", crop: str = "crop_pct") -> DataFrame:
    """A row for each stratum that a row falls in: all, low_tree (10 % at most), no_tree (2 %), cropland and high_tree (50 % at least); unknown cover is in all only."""
    known = F.col(tree).isNotNull() & F.col(crop).isNotNull()
    tests = {"all": F.lit(True), "low_tree": known & (F.col(tree) <= 10), "no_tree": known & (F.col(tree) <= 2), "cropland": known & (F.col(crop) >= 50), "high_tree": known & (F.col(tree) >= 50)}
    return df.withColumn("stratum", F.explode(F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull())))

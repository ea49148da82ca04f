"""Runs of feature sets against each other: a task for each (feature set, species), every fold in it, results kept as they come, so that a run that dies goes on where it was."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hashed_uniform
from .training import Settings, auc, fit

#: Strata of held rows by (tree share, crop share), in percent; rows of unknown cover are in "all" only.
STRATA = {"all": lambda t, c: np.ones(len(t), bool), "low_tree": lambda t, c: t <= 10, "no_tree": lambda t, c: t <= 2, "cropland": lambda t, c: c >= 50, "high_tree": lambda t, c: t >= 50}
RESULT = "feature_set string, species string, stratum string, fold int, n_pos int, n_neg int, auc double, threshold double, tss double, n_trees int, gain map<string,double>"


def best_threshold(y: np.ndarray, p: np.ndarray) -> float:
    """The highest of the thresholds with the best TSS on these rows; 0.5 if they are of one class."""
    order = np.argsort(-p, kind="stable")
    y, p = y[order] > 0, p[order]
    if y.all() or not y.any():
        return 0.5
    tss = np.cumsum(y) / y.sum() - np.cumsum(~y) / (~y).sum()
    last = np.r_[p[1:] != p[:-1], True]  # rows of one score go together
    return float(p[last][np.argmax(tss[last])])


def evaluate(rows: pd.DataFrame, features: Sequence[str], s: Settings, rounds: int, least_train: int, least_held: int) -> list[dict]:
    """Each fold held out once: a model of the others, its threshold from them, and the metrics of the held rows by stratum; too few presences on either side give no row."""
    x, y, fold = rows[list(features)].to_numpy(np.float32), rows["y"].to_numpy(float), rows["fold"].to_numpy()
    tree, crop = rows["tree_pct"].to_numpy(float), rows["crop_pct"].to_numpy(float)
    known, out = np.isfinite(tree) & np.isfinite(crop), []
    for f in np.unique(fold):
        held = fold == f
        if (y[~held] > 0).sum() < least_train or not (y[~held] == 0).any():
            continue
        weight = float(np.clip((y[~held] == 0).sum() / (y[~held] > 0).sum(), 1, 50))
        model = fit(x[~held], y[~held], features, s.for_rows(int((~held).sum())), weight, rounds=rounds)
        cut, p = best_threshold(y[~held], model.predict(x[~held])), model.predict(x[held])
        for name, test in STRATA.items():
            own = np.ones(held.sum(), bool) if name == "all" else known[held] & test(tree[held], crop[held])
            pos, neg = own & (y[held] > 0), own & (y[held] <= 0)
            if pos.sum() >= least_held and neg.any():
                tss = float((p[pos] >= cut).mean() - (p[neg] >= cut).mean())
                out.append({"stratum": name, "fold": int(f), "n_pos": int(pos.sum()), "n_neg": int(neg.sum()), "auc": auc(y[held][own], p[own]), "threshold": cut, "tss": tss, "n_trees": len(model.trees), "gain": model.importance()})
    return out


def run(rows: DataFrame, arms: Mapping[str, Sequence[str]], path: str, batches: int = 8, most: int = 25_000, rounds: int = 60, s: Settings = Settings(), least_train: int = 5, least_held: int = 5, key: str = "cell_id") -> DataFrame:
    """Results of every feature set on every species, kept below ``path`` and returned.

    rows: (species, y, fold, tree_pct, crop_pct, key, features). A species with more presences or others than ``most`` is judged on those of the smallest hashed keys. Cells of the grid that ``path`` has
    are left out, so a call after a death does the rest; each batch is one Spark commit. A cell that gave no metrics is kept, too, as a row without stratum, and not tried again.
    """
    spark = rows.sparkSession
    kind = [c for arm in arms.values() for c in arm]
    order = Window.partitionBy("species", F.col("y") > 0).orderBy(hashed_uniform(F.col(key)), key)
    own = rows.where("species is not null and y is not null and fold is not null").withColumn("species", F.col("species").cast("string"))
    own = own.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most)
    own = own.select("species", F.col("y").cast("int").alias("y"), F.col("fold").cast("int").alias("fold"), "tree_pct", "crop_pct", key, *(F.col(c).cast("double").alias(c) for c in dict.fromkeys(kind)))
    grid = own.select("species").distinct().withColumn("feature_set", F.explode(F.array(*map(F.lit, arms))))
    grid = grid.withColumn("_batch", F.pmod(F.xxhash64("species", "feature_set"), F.lit(batches)))

    def judged(group: pd.DataFrame) -> pd.DataFrame:
        name, sp = group["feature_set"].iloc[0], group["species"].iloc[0]
        found = evaluate(group.sort_values(key, ignore_index=True), arms[name], s, rounds, least_train, least_held) or [{}]
        out = pd.DataFrame([{"feature_set": name, "species": sp, **r} for r in found]).reindex(columns=[c.split()[0] for c in RESULT.split(", ")])
        out = out.astype({c: "Int64" for c in ("fold", "n_pos", "n_neg", "n_trees")})
        return out.assign(**{c: [v if isinstance(v, (str, dict)) else None for v in out[c]] for c in ("stratum", "gain")})

    for b in range(batches):
        todo = grid.where(F.col("_batch") == b).drop("_batch")
        if (at := results(spark, path)) is not None:
            todo = todo.join(at.select("species", "feature_set").distinct(), ["species", "feature_set"], "left_anti")
        if not todo.isEmpty():
            own.join(todo, "species").groupBy("feature_set", "species").applyInPandas(judged, RESULT).write.mode("append").parquet(path)
    return results(spark, path) if results(spark, path) is not None else spark.createDataFrame([], RESULT)


def results(spark, path: str) -> DataFrame | None:
    """What is kept so far."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.schema(RESULT).parquet(path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")) else None


def importance_of(found: DataFrame) -> DataFrame:
    """(feature_set, feature, share): mean share of a feature in its models' gain, over folds and species."""
    each = found.where("stratum = 'all'").select("feature_set", "species", "fold", F.explode("gain").alias("feature", "g"))
    total = Window.partitionBy("feature_set", "species", "fold")
    n = found.where("stratum = 'all'").groupBy("feature_set").agg(F.count("*").alias("n"))
    shares = each.withColumn("share", F.try_divide("g", F.sum("g").over(total))).groupBy("feature_set", "feature").agg(F.sum("share").alias("_s"))
    return shares.join(n, "feature_set").select("feature_set", "feature", (F.col("_s") / F.col("n")).alias("share"))

"""Spatial blocks and folds: whole blocks, never split."""

from __future__ import annotations

from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grid_fold(lat: Column, lon: Column, degrees: float = 10.0, folds: int = 5) -> Column:
    """Fold from the block's place: (7 * lat block + 13 * lon block) mod folds."""
    a, b = F.floor(lat / degrees).cast("int"), F.floor(lon / degrees).cast("int")
    return F.pmod(a * 7 + b * 13, F.lit(folds))


def block_of(lat: Column, lon: Column, degrees: float = 1.0) -> Column:
    """Block number of a regular lattice, a stand-in for clusters that every engine computes alike."""
    return F.floor((lat + 90) / degrees).cast("bigint") * F.lit(int(360 / degrees)) + F.floor((lon + 180) / degrees).cast("bigint")


def kmeans_blocks(df: DataFrame, blocks: int = 20, seed: int = 42) -> DataFrame:
    """Clusters of (lon * cos(mean latitude), lat) with MLlib; fewer than two blocks: all in block 0."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    n, mean = df.agg(F.count("*"), F.avg("latitude")).first()
    if min(blocks, n) < 2:
        return df.withColumn("block", F.lit(0))
    xy = df.withColumns({"_x": F.col("longitude") * F.cos(F.radians(F.lit(max(-89.9, min(89.9, mean))))), "_y": F.col("latitude")})
    v = VectorAssembler(inputCols=["_x", "_y"], outputCol="_v").transform(xy)
    return KMeans(k=min(blocks, n), seed=seed, featuresCol="_v", predictionCol="block").fit(v).transform(v).drop("_x", "_y", "_v")


def greedy_folds(counts: dict[int, int], folds: int = 5) -> dict[int, int]:
    """Largest block to the lightest fold, ties to the lower block and the lower fold; fewer than two folds: none."""
    folds = min(folds, len(counts))
    if folds < 2:
        return {}
    load, out = [0] * folds, {}
    for block in sorted(counts, key=lambda b: (-counts[b], b)):
        f = min(range(folds), key=lambda i: load[i])
        out[block] = f
        load[f] += counts[block]
    return out


def stratified_folds(counts: dict[int, tuple[int, int]], folds: int = 5) -> dict[int, int]:
    """Folds of whole blocks with like shares of absences and presences. counts: (absences, presences) of each block.

    The most uneven and largest blocks go first, each to the fold where the folds' shares of both classes then differ least; ties to the fold of fewer rows, then the lower.
    """
    folds = min(folds, len(counts))
    if folds < 2:
        return {}
    total = [max(1, sum(c[k] for c in counts.values())) for k in (0, 1)]
    load, out = [[0, 0] for _ in range(folds)], {}

    def spread(f: int, c: tuple[int, int]) -> float:
        shares = [[(load[i][k] + (c[k] if i == f else 0)) / total[k] for i in range(folds)] for k in (0, 1)]
        return sum(sum((v - sum(s) / folds) ** 2 for v in s) for s in shares)

    for b in sorted(counts, key=lambda b: (-abs(counts[b][0] / total[0] - counts[b][1] / total[1]), -sum(counts[b]), b)):
        f = min(range(folds), key=lambda i: (spread(i, counts[b]), sum(load[i]), i))
        out[b] = f
        load[f] = [load[f][k] + counts[b][k] for k in (0, 1)]
    return out


def assign_folds(df: DataFrame, block: str = "block", folds: int = 5, most_blocks: int = 10_000) -> DataFrame:
    """df with fold; the blocks (a few tens as a rule) are counted on the cluster and dealt on the driver.

    More than ``most_blocks`` are dealt in a task, as the rule takes one after another, and joined back: a block and a number each are all that it holds.
    """
    counts = df.groupBy(block).count()
    rows = counts.limit(most_blocks + 1).collect()
    if len(rows) > most_blocks:
        kind = df.schema[block].dataType.simpleString()

        def deal(c: pd.DataFrame) -> pd.DataFrame:
            own = greedy_folds(dict(zip(c[block], c["count"])), folds)
            return pd.DataFrame({block: list(own), "fold": list(own.values())})

        of = counts.where(F.col(block).isNotNull()).groupBy().applyInPandas(deal, f"{block} {kind}, fold int")
        return df.join(of, block, "left")
    of = greedy_folds({r[block]: r["count"] for r in rows if r[block] is not None}, folds)
    if not of:
        return df.withColumn("fold", F.lit(None).cast("int"))
    return df.withColumn("fold", F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*sorted(of.items()))]), F.col(block)))


def inner_validation(counts: dict[int, int], share: float = 0.2, seed: int = 42) -> set[int]:
    """Whole blocks in a shuffled order until they hold the share of rows, never all."""
    import random

    order = sorted(counts)
    random.Random(seed).shuffle(order)
    out, held, target = [], 0, share * sum(counts.values())
    for b in order:
        if out and held >= target:
            break
        out.append(b)
        held += counts[b]
    return set(out[:-1] if len(out) == len(order) and len(out) > 1 else out if len(order) > 1 else [])


def fold_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct("block").alias("n_blocks"))

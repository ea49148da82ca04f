"""Running sums and medians of groups of which one holds most rows."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlore.operators import clean, metrics, prefix


def test_medians_of_many_groups(spark):
    r = random.Random(6)
    rows = [("hot", r.gauss(0, 1) * 10 ** r.randrange(-3, 9), float(i % 3)) for i in range(30_000)]
    rows += [(f"g{k}", r.uniform(-1, 1), None if i % 2 else 5.0) for k in range(200) for i in range(r.randrange(1, 9))]
    rows += [("ties", 1.0, 2.0)] * 4000 + [("ties", 7.0, None)] * 4001 + [("nulls", None, None)] * 3 + [(None, 1.0, 1.0)] * 2
    got = {x.k: x for x in prefix.group_medians(spark.createDataFrame(rows, "k string, a double, b double").repartition(8), "k", ["a", "b"]).collect()}
    for k in {x[0] for x in rows if x[0]}:
        for i, c in enumerate("ab", 1):
            want = [x[i] for x in rows if x[0] == k and x[i] is not None]
            assert got[k][c] == (pytest.approx(statistics.median(want)) if want else None)
        assert got[k].n == sum(x[0] == k for x in rows)
    assert None not in got


def test_running_sums_hold_no_group_in_a_window(spark):
    hot = spark.range(0, 1_000_000, 1, 8).select(F.lit("hot").alias("k"), F.xxhash64("id").cast("double").alias("s"), (F.col("id") % 5).alias("c"))
    some = spark.createDataFrame([("x", 1.0, 3), (None, 2.0, 4), (None, 1.0, 1), ("x", -2.0, 6)], "k string, s double, c long")
    ran = prefix.running_by_key(hot.unionByName(some), ["k"], "s", ["c"])
    small = {(x.k, x.s): (x.upto_c, x.all_c) for x in ran.where("k is null or k = 'x'").collect()}
    assert small == {("x", -2.0): (6, 9), ("x", 1.0): (9, 9), (None, 1.0): (1, 5), (None, 2.0): (5, 5)}
    last = ran.where("k = 'hot'").agg(F.count("*"), F.max_by("upto_c", "s"), F.max("all_c"), F.min_by(F.col("upto_c") - F.col("c"), "s")).first()
    assert tuple(last) == (1_000_000, 2_000_000, 2_000_000, 0)


def test_rank_metrics_of_a_very_large_species(spark):
    """A million distinct scores in eight partitions."""
    df = spark.range(0, 1_000_000, 1, 8).select(F.lit("sp").alias("k"), F.col("id").cast("double").alias("score"), (F.col("id") % 10 < F.col("id") / 200_000).cast("int").alias("y"), F.lit(1).alias("mask"), F.col("id").alias("rid"))
    i = np.arange(1_000_000)
    y = i % 10 < i / 200_000
    want = ((i[y] + 1).sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert metrics.auc(df, ["k"]).first().auc == pytest.approx(want, rel=1e-12)
    assert metrics.auc_ordinal(df, ["k"]).first().auc == pytest.approx(want, rel=1e-12)
    tp, fp = np.cumsum(y[::-1])[::-1] / y.sum(), np.cumsum(~y[::-1])[::-1] / (~y).sum()
    best = metrics.max_tss(df, ["k"]).first()
    assert best.tss_max == pytest.approx((tp - fp).max(), rel=1e-12) and (tp - fp)[int(best.threshold)] == pytest.approx(best.tss_max, rel=1e-12)


def test_outliers_equal_plain_medians(spark):
    r = random.Random(1)
    rows = [(i, r.choice("ab"), r.gauss(45, 2), r.gauss(5, 2)) for i in range(600)] + [(1000, "a", -45.0, 170.0), (1001, "b", None, 3.0), (1002, None, 1.0, 1.0), (1003, "c", 80.0, 0.0)]
    df = spark.createDataFrame(rows, "rid long, species string, latitude double, longitude double")
    got = {x.rid for x in clean.range_outliers(df).where("outlier").collect()}
    assert got == {1000}


def test_more_blocks_than_the_driver_deals(spark):
    from gridlore.operators import folds

    df = spark.range(3000).select((F.col("id") * F.col("id") % 211).alias("block")).unionByName(spark.createDataFrame([(None,)], "block long"))
    few, many = (folds.assign_folds(df, most_blocks=n).groupBy("block", "fold").count().collect() for n in (10_000, 10))
    assert sorted(map(str, few)) == sorted(map(str, many)) and len(few) > 100

"""What a staged table's writing shows takes no further job, so the driver has few jobs to keep."""

import pytest
from pyspark.sql import functions as F

from gridlore.llm import components, shared


@pytest.fixture
def jobs(spark):
    """The number of jobs that a call runs."""

    def of(name, call):
        sc = spark.sparkContext
        sc.setJobGroup(name, name)
        try:
            out = call()
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        return out, len(sc.statusTracker().getJobIdsForGroup(name))

    return of


def test_stage_sees_what_it_writes(spark):
    out = shared.stage(spark.range(10).select(F.col("id").alias("n")), "seen", odd=F.count_if(F.col("n") % 2 == 1), **shared.n_seen())
    assert out.seen == {"odd": 5, "rows": 10, "most": 9, "total": 45} and out.count() == 10 and out.columns == ["n"]
    none = shared.stage(spark.range(10).select(F.col("id").alias("n")).where("n > 10"), "seen", **shared.n_seen())
    assert none.seen == {"rows": 0, "most": 0, "total": 0} and none.count() == 0
    grouped = shared.stage(spark.createDataFrame([], "k long").groupBy("k").agg(F.count("*").alias("n")), "seen", **shared.n_seen())
    assert grouped.seen == {"rows": 0, "most": 0, "total": 0}
    assert shared.stage(spark.range(3), "plain").seen == {}


def test_stars_end_without_a_round(spark, jobs):
    stars = [(10 * c, 10 * c + i) for c in range(5) for i in range(1, 6)]
    edges = shared.stage(spark.createDataFrame(stars, "u long, v long"), "stars")
    got, n = jobs("stars", lambda: components.connected_components(edges))
    assert {(x["node"], x["root"]) for x in got.collect()} == {(b, a) for a, b in stars} | {(a, a) for a, _ in stars}
    assert n <= 6


def test_rounds_take_few_jobs(spark, jobs):
    chain = [(i, i + 1) for i in range(8)]
    edges = shared.stage(spark.createDataFrame(chain, "u long, v long"), "chain")
    got, n = jobs("chain", lambda: components.connected_components(edges))
    assert {(x["node"], x["root"]) for x in got.collect()} == {(i, 0) for i in range(9)}
    assert n <= 40


def test_a_seen_largest_count_asks_no_job(spark, jobs):
    many = shared.stage(spark.range(1000).select((F.col("id") % 7).alias("k")), "many")
    one = shared.stage(many.groupBy("k").agg(F.count("*").alias("n")), "one", **shared.n_seen())
    got, n = jobs("spread", lambda: shared.join_spread(many, one, "k", 1000))
    assert n == 0 and got.count() == 1000
    hot = shared.stage(spark.range(1000).select(F.lit(1).alias("k")), "many")
    one = shared.stage(hot.groupBy("k").agg(F.count("*").alias("n")), "one", **shared.n_seen())
    assert "union" in shared.join_spread(hot, one, "k", 1000)._jdf.queryExecution().logical().toString().lower()

"""Background sampling: draws without a pattern in the keys, and target groups against a plain scan."""

import random

from pyspark.sql import functions as F

from gridlore.functions.scalar import hashed_uniform
from gridlore.operators import background as B


def test_draws_follow_no_pattern_of_the_keys(spark):
    n, most = 3_000_000, 24_000
    got = [r[0] for r in B.sample_rows(spark.range(n).withColumnRenamed("id", "rid"), most).collect()]
    assert len(set(got)) == most
    for modulus in (16, 1000, 1_000_003):  # residues, as a linear map would repeat them
        seen = len({g % modulus for g in got})
        assert seen > 0.98 * modulus * (1 - (1 - 1 / modulus) ** most)
    tenths = [sum(n * i // 10 <= g < n * (i + 1) // 10 for g in got) for i in range(10)]
    assert all(abs(t - most / 10) < 300 for t in tenths), tenths  # six standard deviations
    gaps = [b - a for a, b in zip(got, got[1:])]
    assert len(set(gaps)) > 300


def test_uniforms_are_inside_the_interval_and_even(spark):
    r = spark.range(200_000).select(hashed_uniform(F.col("id")).alias("u")).agg(F.min("u"), F.max("u"), F.avg("u"), F.count_distinct("u"), F.avg(F.col("u") * F.col("u"))).first()
    assert 0 < r[0] < r[1] < 1 and abs(r[2] - 0.5) < 0.004 and r[3] == 200_000 and abs(r[4] - 1 / 3) < 0.004
    assert spark.sql("select cast(null as bigint) id").select(hashed_uniform(F.col("id"))).first()[0] is None


def _plain(rows, u, most):
    out = set()
    for s in {x[1] for x in rows}:
        own = {c for _, t, c in rows if t == s}
        free = sorted((u[rid], rid, c) for rid, _, c in rows if c not in own)
        out |= {(s, rid, c) for _, rid, c in free[: min(len(own), most)]}
    return out


def test_target_group_is_that_of_a_plain_scan(spark):
    r = random.Random(11)
    rows = [(i, "much" if r.random() < 0.4 else f"s{r.randrange(30)}", 7 if r.random() < 0.3 else r.randrange(400)) for i in range(4000)]
    rows += [(4000 + i, "lone", 10_000 + i) for i in range(3000)]  # wants more than others have, and nearly all there is
    occ = spark.createDataFrame(rows, "rid bigint, species string, cell_id bigint").repartition(6)
    u = {x[0]: x[1] for x in occ.select("rid", hashed_uniform(F.col("rid"))).collect()}
    for most in (1, 150, 25_000):
        got = [tuple(x) for x in B.target_group(occ, most).select("species", "rid", "cell_id").collect()]
        assert len(got) == len(set(got)) and set(got) == _plain(rows, u, most)
    assert B.target_group(occ.limit(0)).count() == 0
    assert B.target_group(occ.where("species = 'lone'")).count() == 0


def test_species_read_little_more_than_they_want(spark):
    """The stretches that the widest reader needs hold few more rows than it wants, of a large table."""
    u = spark.range(1_000_000).select(F.floor(F.log2(hashed_uniform(F.col("id"))) * B.STEPS).alias("b")).groupBy("b").count()
    c = {x[0]: x[1] for x in u.collect()}
    read, want = 0, 2000
    for b in sorted(c):
        if read >= want:
            break
        read += c[b]
    assert read < 1.1 * want and len(c) < 16 * 24

"""Exploded rows, which Spark's estimate doesn't count, stay out of broadcasts."""

from pyspark.sql import functions as F

from gridlore.functions.grid import Grid
from gridlore.operators import cells, polygons

def broadcast_rows(df):
    """Rows of each broadcast of an executed frame."""
    found, plans = [], [df._jdf.queryExecution().executedPlan()]
    while plans:
        p = plans.pop()
        kind = p.getClass().getSimpleName()
        if kind == "BroadcastExchangeExec":
            found.append(p.metrics().apply("numOutputRows").value())
        inner = "executedPlan" if kind == "AdaptiveSparkPlanExec" else "plan" if kind.endswith("QueryStageExec") else None
        below = [getattr(p, inner)()] if inner else []
        plans += below + [p.children().apply(i) for i in range(p.children().size())]
    return found


def run(spark, make):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 1 << 20)
    try:
        df = make()
        return df.collect(), broadcast_rows(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def lattice(spark, rows, cols):
    """Every third cell has a value."""
    i = F.col("id")
    return spark.range(rows * cols).select(F.floor(i / cols).cast("int").alias("grid_row"), (i % cols).cast("int").alias("grid_col"), F.when(i % 3 == 0, i).alias("v"))


def test_rings_of_many_points(spark):
    at = spark.range(12_000).select(F.col("id").alias("rid"), (F.col("id") % 120).cast("int").alias("grid_row"), F.floor(F.col("id") / 120).cast("int").alias("grid_col"))
    got, rows = run(spark, lambda: cells.ring_fallback(at, lattice(spark, 400, 400), "v"))
    assert all(n <= 12_000 for n in rows)
    assert len(got) == 12_000
    for x in got:
        r, c = x.rid % 120, x.rid // 120
        if (r * 400 + c) % 3 == 0:
            assert (x.v, x.ring) == (r * 400 + c, 0)
        else:
            near = [(i, j) for i in (r - 1, r, r + 1) for j in (c - 1, c, c + 1) if i >= 0 and j >= 0 and (i * 400 + j) % 3 == 0]
            assert (x.v, x.ring) == (near[0][0] * 400 + near[0][1], 1)


def test_rings_of_rows_with_one_rid(spark):
    at = spark.createDataFrame([(1, 0, 1), (1, 0, 3), (2, 90, 90), (3, None, 5)], "rid long, grid_row int, grid_col int")
    got = sorted(tuple(x) for x in cells.ring_fallback(at, lattice(spark, 4, 4), "v").collect() if x.rid == 1)
    assert got == [(1, 3, 0), (1, 3, 0)]
    rest = {x.rid: (x.v, x.ring) for x in cells.ring_fallback(at, lattice(spark, 4, 4), "v").collect() if x.rid > 1}
    assert rest == {2: (None, None), 3: (None, None)}


def test_neighbours_of_many_points(spark):
    i = F.col("id")
    at = spark.range(20_000).select(i.alias("rid"), (i % 120 + 0.75).alias("y"), (F.floor(i / 120) + 1.0).alias("x"))
    grid = lattice(spark, 400, 400).withColumn("v", F.when(F.col("grid_row") % 2 == 0, F.col("grid_col").cast("double")))
    got, rows = run(spark, lambda: cells.bilinear_filled(grid, "v", at))
    assert all(n <= 20_000 for n in rows)
    assert {x.rid: x.v for x in got} == {k: k // 120 + 0.5 for k in range(20_000)}


def test_cells_of_shapes_that_cover_many(spark):
    grid = Grid("g", 200, 100, 0.0, 1.0, 100.0, -1.0)
    corners = F.array(*[F.struct(F.lit(j).alias("seq"), F.lit(x).alias("x"), F.lit(y).alias("y")) for j, (x, y) in enumerate([(-1.0, -1.0), (201.0, -1.0), (201.0, 101.0), (-1.0, 101.0)])])
    shapes = spark.range(40).select(F.col("id").alias("shape"), F.lit(0).alias("ring"), F.inline(corners))

    def count():
        inside = polygons.covered_cells(shapes, grid, all_touched=False)
        both = polygons.covered_cells(shapes, grid).join(inside.withColumn("inside", F.lit(1)), ["shape", "grid_row", "grid_col"], "left")
        return both.groupBy("shape").agg(F.count("*").alias("n"), F.count("inside").alias("inside"))

    got, rows = run(spark, count)
    assert all(n <= 20_000 for n in rows)
    assert sorted(map(tuple, got)) == [(k, 20_000, 20_000) for k in range(40)]

"""Polygons over cells, area averages and training over partitions against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlore.functions.grid import Grid
from gridlore.operators import deepnet, polygons, score, shapes, warp

GRID = Grid("g", 30, 24, 0.0, 1.0, 24.0, -1.0)


def star(r, cx, cy, size, n):
    return [(cx + math.cos(2 * math.pi * i / n) * size * r.uniform(0.3, 1), cy + math.sin(2 * math.pi * i / n) * size * r.uniform(0.3, 1)) for i in range(n)]


def vertices(spark, many):
    rows = [(k, i, j, float(x), float(y)) for k, rings in many.items() for i, ring in enumerate(rings) for j, (x, y) in enumerate(ring)]
    return spark.createDataFrame(rows, "shape int, ring int, seq int, x double, y double")


def test_many_polygons_equal_the_plain_scan(spark):
    r = random.Random(5)
    many = {k: [star(r, r.uniform(-2, 32), r.uniform(-2, 26), r.uniform(0.3, 12), r.randrange(3, 12))] for k in range(150)}
    for k in range(0, 150, 3):
        x, y = np.mean(many[k][0], axis=0)
        many[k].append(star(r, x, y, 0.8, 5))  # a hole
    got = {}
    for x in polygons.covered_cells(vertices(spark, many), GRID).collect():
        got.setdefault(x.shape, set()).add((x.grid_row, x.grid_col))
    for k, rings in many.items():
        assert got.get(k, set()) == {tuple(c) for c in shapes.touched_cells(rings, GRID).tolist()}, k


def test_centres_holes_and_nulls(spark):
    many = {1: [[(2, 2), (8, 2), (8, 8), (2, 8)], [(4, 4), (6, 4), (6, 6), (4, 6)]], 2: [[(40, 40), (50, 40), (50, 50)]]}
    v = vertices(spark, many).unionByName(spark.createDataFrame([(1, 0, 9, None, 3.0)], "shape int, ring int, seq int, x double, y double"))
    got = {(x.shape, x.grid_row, x.grid_col) for x in polygons.covered_cells(v, GRID, all_touched=False).collect()}
    assert got == {(1, r, c) for r in range(16, 22) for c in range(2, 8)} - {(1, r, c) for r in (18, 19) for c in (4, 5)}
    assert polygons.covered_cells(v.where("false"), GRID).count() == 0


def test_clips_need_the_same_lattice(spark):
    large = Grid("large", 60, 60, -10.0, 1.0, 34.0, -1.0)
    assert polygons.offset(large, GRID) == (10, 10)
    for bad in (Grid("b", 5, 5, 0.25, 1.0, 24.0, -1.0), Grid("b", 5, 5, 0.0, 0.5, 24.0, -1.0)):
        with pytest.raises(ValueError, match="not a window"):
            polygons.offset(large, bad)
    with pytest.raises(ValueError, match="beyond"):
        polygons.offset(GRID, large)
    cells = spark.range(3600).select((F.col("id") / 60).cast("int").alias("grid_row"), (F.col("id") % 60).cast("int").alias("grid_col"), "id")
    got = polygons.clip_to_shape(cells, vertices(spark, {7: [[(2.2, 2.2), (3.8, 2.2), (3.8, 2.8), (2.2, 2.8)]]}), GRID, large).collect()
    assert {(x.shape, x.grid_row, x.grid_col, x.id) for x in got} == {(7, 21, 2, 31 * 60 + 12), (7, 21, 3, 31 * 60 + 13)}


def test_the_first_key_with_a_shape_counts(spark):
    rows = spark.createDataFrame([(1, None, "FRA", "FR", 5.0), (2, None, "FRA", None, 9.0), (3, None, "ESP", "FRA", 99.0)], "id int, a string, b string, c string, area double")
    assert [x.id for x in polygons.preferred_shapes(rows, ["a", "b", "c"], "FRA").collect()] == [2, 1]
    assert polygons.preferred_shapes(rows, ["a", "b"], "XXX").collect() == []


def test_area_averages(spark):
    source, target = Grid("s", 4, 4, 0.0, 1.0, 4.0, -1.0), Grid("t", 2, 2, 0.5, 1.5, 4.0, -1.5)
    cells = spark.createDataFrame([(r, c, None if (r, c) == (0, 0) else float(10 * r + c)) for r in range(4) for c in range(4)], "grid_row int, grid_col int, v double")
    got = {(x.grid_row, x.grid_col): (x.v, x.share) for x in warp.area_average(cells, source, target, ["v"]).collect()}
    # target (0, 0): columns 0.5 to 2 and rows 0 to 1.5 of the source: halves of column 0 and of row 1
    want = (1 * 1 + 10 * 0.25 + 11 * 0.5) / (1 + 0.25 + 0.5)
    assert got[0, 0] == (pytest.approx(want), pytest.approx(1)) and set(got) == {(0, 0), (0, 1), (1, 0), (1, 1)}
    # a target that covers the source keeps its total
    fine = Grid("f", 50, 50, -1.0, 0.13, 5.0, -0.13)
    whole = warp.area_average(cells.fillna(7.0), source, fine, ["v"]).agg(F.sum(F.col("v") * F.col("share")) * 0.13**2).first()[0]
    assert whole == pytest.approx(sum(10 * r + c for r in range(4) for c in range(4)) + 7)
    assert warp.area_average(cells.where("grid_row = 0 and grid_col = 0"), source, target, ["v"]).first().v is None


@pytest.mark.parametrize("kind", ["deepmaxent", "poisson", "bce"])
def test_training_over_partitions_equals_one_process(spark, kind, monkeypatch):
    monkeypatch.setattr(deepnet, "DIRECT", 2)  # sums of sums
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 3))
    y = (r.random((300, 2)) < 1 / (1 + np.exp(-x[:, :2]))).astype(float) * (1 if kind == "bce" else r.integers(1, 4, (300, 2)))
    x[::17, 1] = np.nan
    mask = r.random((300, 2)) < 0.8 if kind == "bce" else None
    rows = [(*map(float, a), *(float(v) if mask is None or mask[i, k] else None for k, v in enumerate(b))) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "a double, b double, c double, s double, t double").repartition(7)
    how = dict(hidden=6, layers=2, epochs=8, kind=kind, seed=3)
    one, many = score.train_network(x, y, "abc", "st", mask=mask, **how), deepnet.fit_network(df, list("abc"), list("st"), **how)
    assert np.allclose(one.intensity(x), many.intensity(x), atol=1e-6) and np.allclose(one.log_z, many.log_z, atol=1e-6) and np.allclose(one.predict(x), many.predict(x), atol=1e-6)
    with pytest.raises(ValueError, match="no cells"):
        deepnet.fit_network(df.where("false"), list("abc"), list("st"))
    with pytest.raises(ValueError, match="no loss"):
        deepnet.fit_network(df, list("abc"), list("st"), kind="other")

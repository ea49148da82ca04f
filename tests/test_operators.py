"""Operators on small hand-made frames: boundaries, ties, missing values."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlore.functions import grid as G
from gridlore.functions import scalar as S
from gridlore.operators import background, cells, clean, climate, folds, landcover, metrics, recommend, score, thin
from gridlore.plans import guards
from gridlore.sources import tables
from gridlore.streaming import upsert


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first().asDict()


def test_grid_window_and_nesting():
    assert G.Grid("f", 20, 20, 0, 1 / 120, 10, -1 / 120).nests(G.Grid("c", 1, 1, 0, 1 / 6, 10, -1 / 6)) == 20
    assert G.GLOBAL_10M.window(-98, 31, -96.5, 33) == (342, 353, 492, 500)
    with pytest.raises(ValueError):
        G.USA_30S.window(10, 10, 11, 11)


def test_rounding_and_phrases(spark):
    r = one(spark, a=S.decimals(F.lit(30.25)), b=S.decimals(F.lit(30.0)), c=S.distance_phrase(F.lit(1.4), F.lit(0.0)), d=S.distance_phrase(F.lit(12.5), F.lit(359.0)), e=S.clip(F.lit(None).cast("double"), 0, 1), f=S.bio_number(F.lit("x/wc_bio_12.tif")))
    assert (r["a"], r["b"], r["c"], r["d"], r["e"], r["f"]) == (2, 0, "under 2 km north", "about 12 km north", None, 12)


def test_attribution_order_and_nulls(spark):
    rows = [(1, "a", None, 1.0, 2000), (2, "a", 0.0, 0.0, 2000), (3, "a", 31.0, -97.0, 2000), (4, "a", 31.0, -97.0, 2001), (5, "a", 32.0, -32.0, 1990), (6, "a", 80.0, 10.0, None)]
    df = spark.createDataFrame(rows, "rid long, species string, latitude double, longitude double, year int")
    got = {r["rid"]: r["drop_reason"] for r in clean.clean(df, (-100.0, 30.0, -95.0, 35.0)).collect()}
    assert got == {1: "bad_coordinate", 2: "null_island", 3: None, 4: "duplicate", 5: "lat_equals_lon", 6: "outside"}


def test_thin_prefers_newest_then_first(spark):
    rows = [(1, "a", 31.0, -97.0, None), (2, "a", 31.0, -97.0, 2001), (3, "a", 31.0, -97.0, 2001), (4, "b", 31.0, -97.0, None)]
    df = spark.createDataFrame(rows, "rid long, species string, latitude double, longitude double, year int")
    got = {(r["species"], r["rid"], r["n_records"]) for r in thin.thin(df, G.GLOBAL_10M).collect()}
    assert got == {("a", 2, 3), ("b", 4, 1)}


def brute_auc(s, y):
    p, n = s[y == 1], s[y == 0]
    return ((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n))


def test_rank_metrics_against_brute_force(spark):
    rng = np.random.default_rng(1)
    s, y = rng.integers(0, 20, 300) / 8, rng.integers(0, 2, 300)
    df = spark.createDataFrame([(1, float(a), int(b), i) for i, (a, b) in enumerate(zip(s, y))], "g int, score double, y int, rid int")
    assert metrics.auc(df, ["g"]).first()["auc"] == pytest.approx(brute_auc(s, y), abs=1e-12)
    best = max(((s[y == 1] >= t).mean() - (s[y == 0] >= t).mean(), t) for t in set(s))
    r = metrics.max_tss(df, ["g"]).first()
    assert (r["tss_max"], r["threshold"]) == (pytest.approx(best[0]), best[1])
    assert metrics.auc(df.where("y = 1"), ["g"]).first()["auc"] is None


def test_bioclim_first_index_on_ties(spark):
    flat = [5.0] * 12
    df = spark.createDataFrame([(1, flat, [9.0] * 12, [1.0] * 12), (2, flat, flat, [None] + [1.0] * 11)], "cell_id long, tmin array<double>, tmax array<double>, prec array<double>")
    a, b = sorted(climate.bioclim(df).collect(), key=lambda r: r["cell_id"])
    assert (a["bio_1"], a["bio_2"], a["bio_7"], a["bio_12"], a["bio_8"]) == (7.0, 4.0, 4.0, 12.0, 7.0) and b["bio_1"] is None


def test_anomaly_guards_nulls(spark):
    n = F.lit(None).cast("double")
    r = one(spark, a=climate.anomaly(12, F.lit(100.0), F.lit(0.0), F.lit(50.0)), b=climate.anomaly(12, n, F.lit(1.0), F.lit(1.0)), c=climate.anomaly(1, F.lit(3.0), F.lit(1.0), F.lit(2.0)))
    assert (r["a"], r["b"], r["c"]) == (2000.0, None, 4.0)


def test_penman_by_hand(spark):
    from math import acos, cos, exp, pi, radians, sin, tan

    tmin, tmax, srad, wind, vapr, z, lat, month = 12.0, 25.0, 18.0, 2.0, 1.5, 200.0, 45.0, 6
    es = lambda t: 0.6108 * exp(17.27 * t / (t + 237.3))
    dr, de, phi = 1 + 0.033 * cos(2 * pi * 166 / 365), 0.409 * sin(2 * pi * 166 / 365 - 1.39), radians(lat)
    su = acos(-tan(phi) * tan(de))
    ra = 24 * 60 / pi * 0.082 * dr * (su * sin(phi) * sin(de) + cos(phi) * cos(de) * sin(su))
    t, ep = (tmin + tmax) / 2, (es(tmin) + es(tmax)) / 2
    slope, gamma = 4098 * es(t) / (t + 237.3) ** 2, 0.665e-3 * 101.3 * ((293 - 0.0065 * z) / 293) ** 5.26
    cloud = min(1.0, max(0.05, 1.35 * srad / ((0.75 + 2e-5 * z) * ra) - 0.35))
    rnl = 4.903e-9 * ((tmax + 273.16) ** 4 + (tmin + 273.16) ** 4) / 2 * (0.34 - 0.14 * vapr**0.5) * cloud
    want = 30 * (0.408 * slope * (0.77 * srad - rnl) + gamma * 900 / (t + 273) * wind * (ep - vapr)) / (slope + gamma * (1 + 0.34 * wind))
    n = F.lit(None).cast("double")
    r = one(spark, a=climate.penman(*map(F.lit, (tmin, tmax, srad, wind, vapr, z, lat)), month), b=climate.penman(F.lit(tmin), F.lit(tmax), F.lit(srad), F.lit(wind), n, F.lit(z), F.lit(lat), month))
    assert r["a"] == pytest.approx(want, rel=1e-9) and r["b"] is None


def test_exclusions(spark):
    r = one(spark, a=landcover.apply_exclusions(F.lit(0.5), F.lit(255)), b=landcover.apply_exclusions(F.lit(0.5), F.lit(48)), c=landcover.effective_mask(F.lit(None).cast("int")))
    assert (r["a"], r["b"], r["c"]) == (None, 0.5, 15)


def test_gates_at_their_boundaries(spark):
    r = one(spark, a=recommend.confidence(F.lit(0.70), F.lit(0.85), F.lit(4)), b=recommend.confidence(F.lit(0.50), F.lit(0.75), F.lit(0)), c=recommend.bucket(F.lit(False), F.lit(0.70), F.lit(0)), d=recommend.future_note(F.lit(0.5), F.lit(None).cast("double")))
    assert (r["a"], r["b"], r["c"], r["d"]) == ("Looks like records", "Somewhat like records", "well_matched", "")
    df = spark.createDataFrame([(0.30,), (0.2999,), (float("nan"),), (None,)], "p double")
    assert recommend.gated(df).count() == 1


def test_quota_never_negative(spark):
    df = spark.createDataFrame([(1, f"s{i}", "well_matched" if i < 4 else "general", 50.0 + i, None) for i in range(8)], "site int, species string, `group` string, percentile double, passes boolean")
    for top in (0, 1, 5):
        assert recommend.quota_rank(df, top).count() == max(1, top)


def test_folds(spark):
    assert folds.greedy_folds({1: 10, 2: 8, 3: 5, 4: 5}, 2) == {1: 0, 2: 1, 3: 1, 4: 0}
    assert folds.greedy_folds({1: 3}, 5) == {}
    chosen = folds.inner_validation({i: 10 for i in range(10)})
    assert 1 <= len(chosen) < 10


def test_booster_walks_like_by_hand():
    tree = {"left_children": [1, -1, -1], "right_children": [2, -1, -1], "split_indices": [0, 0, 0], "split_conditions": [1.5, -0.5, 0.5], "default_left": [1, 0, 0], "loss_changes": [2.0, 0, 0]}
    text = json.dumps({"learner": {"learner_model_param": {"base_score": "[5E-1]", "num_feature": "1"}, "gradient_booster": {"model": {"trees": [tree]}}}})
    b = score.Booster.from_json(text)
    sig = lambda z: 1 / (1 + np.exp(-z))
    assert np.allclose(b.predict(np.array([[1.0], [1.5], [np.nan]])), [sig(-0.5), sig(0.5), sig(-0.5)]) and b.importance() == {"f0": 2.0}


def test_network_gradient_and_losses():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(60, 3)), rng.integers(0, 2, (60, 2)).astype(float)
    for kind in ("deepmaxent", "poisson", "bce", "ce"):
        z = rng.normal(size=y.shape)
        loss, g = score._losses(z, y, kind)
        d = np.zeros_like(z)
        d[3, 1] = 1e-5
        assert (score._losses(z + d, y, kind)[0] - score._losses(z - d, y, kind)[0]) / 2e-5 == pytest.approx(g[3, 1], rel=1e-3, abs=1e-8)
    net = score.train_network(x, y, list("abc"), ["s", "t"], hidden=6, epochs=30)
    s = net.sensitivity(x[:1], 0)[0]
    step = np.zeros(3)
    step[1] = 1e-6 * net.sd[1]
    assert abs((net.intensity(x[:1] + step) - net.intensity(x[:1] - step))[0, 0]) / 2e-6 == pytest.approx(s[1], rel=1e-3)


def test_separated_choice(spark):
    df = spark.createDataFrame([(0, i) for i in range(10)], "grid_row int, grid_col int")
    g = G.Grid("t", 100, 100, 0.0, 0.01, 0.5, -0.01)
    assert [r["grid_col"] for r in cells.separated(df.orderBy("grid_col"), g, 3.0, 3)] == [0, 3, 6]


def test_box_smoothing_keeps_constants(spark):
    df = spark.range(30).selectExpr("cast(id div 6 as int) grid_row", "cast(id % 6 as int) grid_col", "2.0D v")
    assert {round(r["v"], 9) for r in landcover.box_smooth(df, "v", 2, 2, 5, 6).collect()} == {2.0}


def test_sources(spark, tmp_path):
    (tmp_path / "o.csv").write_text("Species,latitude,longitude,year,country,basis\na,1.5,x,2001.0,US,H\n")
    r = tables.occurrences(spark, str(tmp_path / "o.csv")).first()
    assert (r["latitude"], r["longitude"], r["year"]) == (1.5, None, 2001)
    (tmp_path / "l.csv").write_text("# c\nspecies,common_name,use,notes\n a , A,u,n\nb,B,,\na,AA,,\n\n")
    assert [x["species"] for x in tables.species_list(spark, str(tmp_path / "l.csv")).collect()] == ["a", "b"]
    (tmp_path / "g.json").write_text(json.dumps({"width": 10, "height": 5, "transform": [0.1, 0, 2.0, 0, -0.1, 9.0]}))
    g = tables.grid_manifest(spark, str(tmp_path / "g.json"), "g")
    assert (g.width, g.c, g.f, g.e) == (10, 2.0, 9.0, -0.1)
    with pytest.raises(ValueError):
        tables.require_columns(spark.range(1), ["x"])


def test_common_names(spark):
    a = spark.createDataFrame([("s", None, "big; tall")], "species string, common_name string, notes string")
    b = spark.createDataFrame([("s", "Oak", "Tall; old")], "species string, common_name string, notes string")
    r = tables.common_names([a, b]).first()
    assert (r["common_name"], r["notes"]) == ("Oak", "big; tall; old")


def test_guards(spark):
    with pytest.raises(ValueError):
        guards.assert_trainable(["x/ndvi_mean.tif"])
    for name in ("country/treecover_2020.tif", "sat/ndvi2020.tif", "land_cover/lc.tif", "Satellite2/a.tif"):
        with pytest.raises(ValueError):
            guards.assert_trainable([name])
    guards.assert_trainable(["climate/bio_1.tif", "soil/ph_h2o.tif"])
    guards.assert_inside(30.0, -100.0, (-100.0, 30.0, -90.0, 40.0))
    with pytest.raises(ValueError):
        guards.assert_inside(29.9, -100.0, (-100.0, 30.0, -90.0, 40.0))
    with guards.allow_vegetation("a test"):
        guards.assert_trainable(["ndvi"])
    with pytest.raises(ValueError):
        guards.assert_contract(spark.createDataFrame([(1, 2)], "b int, a int"), ["a", "b"])


def test_weighted_without_replacement_skips_zero(spark):
    df = spark.createDataFrame([(i, float(i % 2)) for i in range(10)], "cell_id long, weight double")
    assert {r["cell_id"] % 2 for r in background.weighted_without(df, 8).collect()} == {1}


def test_latest_row(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "k string, t int, v string")
    assert upsert.latest(df, ["k"], "t").first()["v"] == "y"


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(1, "a", "2024-01-01 00:10:00"), (2, "b", "2024-01-01 00:20:00"), (2, "b", "2024-01-01 00:20:00"), (3, "a", "2024-01-01 01:05:00")]
    spark.createDataFrame(rows, "id int, k string, t string").selectExpr("id", "k", "cast(t as timestamp) t").write.parquet(src)
    stream = lambda: spark.readStream.schema("id int, k string, t timestamp").parquet(src)
    for _ in range(2):  # a second start finds nothing new
        upsert.append_stream(stream(), str(tmp_path / "out"), str(tmp_path / "cp"), ["id"]).start().awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]
    q = upsert.windowed_counts(stream(), "t", "k").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["k"], r["window"].start.hour): r["n"] for r in spark.table("counts").collect()}
    assert got == {("a", 0): 1, ("b", 0): 2, ("a", 1): 1}


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns and set(e.oracle_sql()) <= set(e.queries())

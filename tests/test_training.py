"""Boosted trees, folds and saved models on small inputs."""

import numpy as np
import pandas as pd
import pytest

from gridlore.operators import folds, training
from gridlore.operators.score import Booster, Network, _losses, mean_auc, train_network
from gridlore.plans import q_recommend
from gridlore.sources import models


def data(n=1200, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).astype(np.float32)
    x[rng.random(n) < 0.1, 1] = np.nan
    y = ((x[:, 0] > 0.3) ^ (np.nan_to_num(x[:, 1]) > 0.5)).astype(float)
    return x, y


def test_trees_learn_and_stop_early():
    x, y = data()
    s = training.Settings(rounds=80, patience=10).for_rows(len(y))
    m = training.fit(x[:900], y[:900], ["a", "b", "c"], s, held=(x[900:], y[900:]))
    assert training.auc(y[900:], m.margins(x[900:])) > 0.95 and len(m.trees) <= 80
    assert m.importance()["a"] > 10 * m.importance().get("c", 0)
    noise = training.fit(x[:900], np.random.default_rng(3).integers(0, 2, 900).astype(float), ["a", "b", "c"], s, held=(x[900:], y[900:]))
    assert len(noise.trees) < 80


def test_first_split_is_the_best_of_all():
    """A tree of depth one against every cut and both sides for missing values."""
    x, y = data(200)
    s = training.Settings(depth=1, rows=1.0, columns=1.0, child_weight=1.0, gamma=0.0, l1=0.0)
    tree = training.fit(x, y, ["a", "b", "c"], s, rounds=1).trees[0]
    g, h = 0.5 - y, np.full(len(y), 0.25)
    worth = lambda m: g[m].sum() ** 2 / (h[m].sum() + s.l2)
    best = 0.0
    for f in range(3):
        for cut in np.unique(x[np.isfinite(x[:, f]), f]):
            for missing_left in (True, False):
                left = np.where(np.isnan(x[:, f]), missing_left, x[:, f] < cut)
                if left.any() and not left.all() and min(h[left].sum(), h[~left].sum()) >= 1:
                    best = max(best, 0.5 * (worth(left) + worth(~left) - worth(np.ones(len(y), bool))))
    assert tree["gain"][0] == pytest.approx(best, rel=1e-5)


def test_models_come_back_as_they_were(spark, tmp_path):
    x, y = data(300)
    m = training.fit(x, y, ["a", "b", "c"], training.Settings(rounds=5).for_rows(300), rounds=5)
    assert np.array_equal(Booster.from_json(m.to_json()).predict(x), m.predict(x))
    net = q_recommend._toy_network()
    assert np.array_equal(Network.from_json(net.to_json()).predict(x[:, :2]), net.predict(x[:, :2]))
    path = str(tmp_path / "models")
    models.save_models(spark.createDataFrame([("oak", m.to_json()), ("net", net.to_json()), ("none", None)], "species string, model string"), path)
    assert isinstance(models.load_model(spark, path, "oak"), Booster) and isinstance(models.load_model(spark, path, "net"), Network)
    with pytest.raises(ValueError):
        models.load_model(spark, path, "none")
    cells = spark.createDataFrame([(i, *map(float, v), i % 2 == 0) for i, v in enumerate(x[:40])], "cell_id long, a double, b double, c double, shut boolean")
    out = models.suitability_map(cells, m, ["a", "b", "c"], 0.5, "shut").collect()
    assert all((r["suitability"] is None) == (r["cell_id"] % 2 == 0) and (r["suitability"] is None or r["recommended"] == int(r["suitability"] >= 0.5)) for r in out)


def test_reference_scores_are_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([("a", 0.5), ("a", 0.25)], "species string, score double")

    for _ in range(2):
        assert models.reference_scores(spark, str(tmp_path), "v1", build).count() == 2
    assert len(calls) == 1
    assert models.resolve(spark, "reference-v1", ["/nowhere", str(tmp_path)]) == f"{tmp_path}/reference-v1" and models.resolve(spark, "/a/b", []) == "/a/b"
    with pytest.raises(FileNotFoundError):
        models.first_existing(spark, ["/nowhere/x"], "layer")


def test_stratified_folds():
    rng = np.random.default_rng(2)
    counts = {b: (int(rng.integers(10, 200)), int(rng.integers(0, 60))) for b in range(20)}
    of = folds.stratified_folds(counts)
    assert set(of) == set(counts) and set(of.values()) == set(range(5))
    shares = np.array([[sum(counts[b][k] for b in of if of[b] == f) for k in (0, 1)] for f in range(5)]) / np.array([sum(c[k] for c in counts.values()) for k in (0, 1)])
    assert (abs(shares - 0.2) < 0.08).all()
    assert folds.stratified_folds({1: (3, 4)}) == {}


def test_train_species(spark):
    x, y = data(600)
    rows = [(s, i, int(i * 7 % 11), int(y[i] if s == "one" else 0), *(None if np.isnan(v) else float(v) for v in x[i])) for s in ("one", "flat") for i in range(600)]
    df = spark.createDataFrame(rows, "species string, cell_id long, block int, y int, a double, b double, c double")
    got = {r["species"]: r for r in training.train_species(df, ["a", "b", "c"], s=training.Settings(rounds=40, patience=8)).collect()}
    assert got["one"]["auc"] > 0.85 and got["one"]["n_usable"] == 5 and got["one"]["n_trees"] >= 10 and len(Booster.from_json(got["one"]["model"]).trees) == got["one"]["n_trees"]
    assert got["flat"]["model"] is None and got["flat"]["auc"] is None and got["flat"]["n_rows"] == 600
    assert pd.notna(got["one"]["auc"]) and training.train_species(df.where("false"), ["a", "b", "c"]).count() == 0


def test_masked_network_stops_by_the_held_out_auc():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 3))
    y = np.column_stack([x[:, 0] > 0, x[:, 1] > 0.5]).astype(float)
    mask = rng.random(y.shape) < 0.6
    wrong = np.where(mask, y, 1 - y)  # what the mask hides is never learnt
    held = (x[400:], y[400:], None)
    net = train_network(x[:400], wrong[:400], ["a", "b", "c"], ["s", "t"], hidden=8, epochs=300, kind="bce", mask=mask[:400], held=held, patience=5)
    assert mean_auc(y[400:], net.intensity(x[400:])) > 0.95
    loss, g = _losses(np.zeros((4, 1)), np.array([[1.0], [0], [1], [0]]), "bce", np.array([[1], [0], [0], [1]]))
    assert loss == pytest.approx(np.log(2), abs=1e-6) and g.ravel().tolist() == [-0.25, 0, 0, 0.25]
    assert mean_auc(np.ones((3, 1)), np.zeros((3, 1))) == 0.5

"""The ablation grid: metrics by stratum, resumed runs, verdicts and importance."""

import random

import numpy as np
import pytest

from gridlore.operators import ablation, metrics, training

ROWS = "species string, y int, fold int, tree_pct double, crop_pct double, cell_id long, a double, b double"
FAST = training.Settings(depth=2, rate=0.3, rows=1.0, columns=1.0, child_weight=1.0)


def made(spark, n=400, species=("x", "y")):
    """y follows a and b: the arm with both is better."""
    r = random.Random(3)
    rows = []
    for sp in species:
        for i in range(n):
            a, b = r.random(), r.random()
            rows.append((sp, int(a + b > 1), i % 4, r.choice([None, r.random() * 100]), r.random() * 100, i, a, b))
    rows += [("rare", int(i < 3), i % 4, 1.0, 1.0, i, 0.5, 0.5) for i in range(30)] + [(None, 1, 0, 1.0, 1.0, 1, 0.1, 0.2)]
    return spark.createDataFrame(rows, ROWS)


def test_thresholds():
    y, p = np.array([1, 1, 0, 1, 0]), np.array([0.9, 0.7, 0.7, 0.6, 0.1])
    best = max(((p[y > 0] >= t).mean() - (p[y == 0] >= t).mean(), t) for t in set(p))
    assert ablation.best_threshold(y, p) == pytest.approx(best[1]) and ablation.best_threshold(np.ones(3), p[:3]) == 0.5


def test_a_run_that_dies_goes_on(spark, tmp_path, monkeypatch):
    path, df, arms = str(tmp_path / "runs"), made(spark), {"a": ["a"], "both": ["a", "b"]}
    seen, results = [], ablation.results

    def dies(s, p):
        seen.append(p)
        if len(seen) == 3:
            raise RuntimeError("killed")
        return results(s, p)

    how = dict(batches=4, rounds=8, s=FAST)
    monkeypatch.setattr(ablation, "results", dies)
    with pytest.raises(RuntimeError):
        ablation.run(df, arms, path, **how)
    monkeypatch.setattr(ablation, "results", results)
    kept = {(x.species, x.feature_set) for x in results(spark, path).collect()}
    assert 0 < len(kept) < 6
    found = ablation.run(df, arms, path, **how)
    assert {(x.species, x.feature_set) for x in found.collect()} == {(s, a) for s in ("x", "y", "rare") for a in arms}
    assert found.count() == found.select("feature_set", "species", "stratum", "fold").distinct().count()  # nothing twice
    assert {x.stratum for x in found.where("species = 'rare'").collect()} == {None}  # too few presences, kept as done
    whole = ablation.run(df, arms, str(tmp_path / "other"), **how)
    value = lambda d: sorted((x.feature_set, x.species, x.stratum, x.fold, x.n_pos, round(x.auc, 9), round(x.tss, 9)) for x in d.where("stratum is not null").collect())
    assert value(found) == value(whole)

    rows = [r for r in made(spark).where("species = 'x' and fold = 1").collect()]
    low = found.where("species = 'x' and fold = 1 and stratum = 'low_tree' and feature_set = 'a'").first()
    assert low is None or low.n_pos == sum(r.y for r in rows if r.tree_pct is not None and r.tree_pct <= 10)
    deltas = metrics.paired_deltas(found.where("stratum is not null"), "a", ["auc", "tss"])
    head = deltas.where("stratum = 'all' and metric = 'auc' and feature_set = 'both'").first()
    assert head.mean_delta > 0.1 and head.n == 8 and metrics.verdict(deltas, "both").first().headline == head.mean_delta
    share = {(x.feature_set, x.feature): x.share for x in ablation.importance_of(found).collect()}
    assert share["a", "a"] == pytest.approx(1) and share["both", "a"] + share["both", "b"] == pytest.approx(1) and share["both", "b"] > 0.3


def test_nothing_to_do(spark, tmp_path):
    assert ablation.run(made(spark).where("false"), {"a": ["a"]}, str(tmp_path / "none"), batches=1, rounds=2, s=FAST).count() == 0

"""Training of one boosted-tree model for each species, in tasks: grouped folds, early stopping, a final fit on all rows.

A species' rows are one group, at most ``most`` presences and as many background rows (the caps of the sampling step), so a task's memory is bounded.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hashed_uniform
from .folds import stratified_folds
from .score import Booster


@dataclass(frozen=True)
class Settings:
    # The parameters models of this kind are trained with.
    rounds: int = 500
    patience: int = 30
    depth: int = 5
    rate: float = 0.05
    rows: float = 0.8
    columns: float = 0.6
    child_weight: float = 10.0
    gamma: float = 1.0
    l2: float = 5.0
    l1: float = 0.5
    bins: int = 256
    folds: int = 5
    least_trees: int = 10
    seed: int = 42

    def for_rows(self, n: int) -> Settings:
        """Looser for small samples."""
        if n < 400:
            return replace(self, depth=4, child_weight=4, gamma=0.5, l2=3.0)
        return replace(self, child_weight=6, gamma=0.8, l2=4.0) if n < 2000 else self


def auc(y: np.ndarray, p: np.ndarray) -> float:
    """Mann-Whitney with average ranks."""
    ranks = pd.Series(p).rank().to_numpy()
    pos = y > 0
    n = pos.sum()
    return float((ranks[pos].sum() - n * (n + 1) / 2) / (n * (len(y) - n)))


class Binned:
    """Features as bin numbers; the last bin of each is for missing values."""

    def __init__(self, x: np.ndarray, bins: int):
        self.cuts = []
        for v in x.T:
            own = np.unique(v[np.isfinite(v)])
            self.cuts.append(((own[:-1] + own[1:]) / 2 if len(own) < bins else np.unique(np.quantile(own, np.arange(1, bins - 1) / (bins - 1)))).astype(np.float32))
        self.width = 2 + max((len(c) for c in self.cuts), default=0)
        self.of = self.bin(x)

    def bin(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.where(np.isfinite(v), np.searchsorted(c, v.astype(np.float32), "right"), self.width - 1) for v, c in zip(x.T, self.cuts)])


def _tree(b: Binned, rows: np.ndarray, cols: np.ndarray, g: np.ndarray, h: np.ndarray, s: Settings) -> dict[str, np.ndarray]:
    """One tree, level by level: histograms of gradients by node, feature and bin; missing values go where they gain more."""
    cut = lambda v: np.sign(v) * np.maximum(np.abs(v) - s.l1, 0)
    worth = lambda v, w: cut(v) ** 2 / (w + s.l2)
    t = {k: [] for k in ("left", "right", "feature", "at", "default_left", "gain")}

    def add(total_g: float, total_h: float) -> int:
        for k, v in zip(t, (-1, -1, 0, -s.rate * cut(total_g) / (total_h + s.l2), False, 0.0)):
            t[k].append(v)
        return len(t["left"]) - 1

    add(g[rows].sum(), h[rows].sum())
    node, open_ = np.zeros(len(rows), np.int64), [0]
    for _ in range(s.depth):
        grown = []
        place = {n: i for i, n in enumerate(open_)}
        live = np.isin(node, open_)
        at, r = np.array([place[n] for n in node[live]], np.int64), rows[live]
        best = {n: (0.0,) for n in open_}
        for f in cols:
            key = at * b.width + b.of[r, f]
            sums = [np.bincount(key, w[r], len(open_) * b.width).reshape(len(open_), -1) for w in (g, h)]
            (mg, mh), (G, H) = [x[:, -1:] for x in sums], [x.sum(axis=1, keepdims=True) for x in sums]
            cg, ch = (np.cumsum(x[:, :-1], axis=1)[:, : len(b.cuts[f])] for x in sums)
            for missing_left in (True, False):
                lg, lh = (cg + mg, ch + mh) if missing_left else (cg, ch)
                gain = 0.5 * (worth(lg, lh) + worth(G - lg, H - lh) - worth(G, H)) - s.gamma
                gain[(lh < s.child_weight) | (H - lh < s.child_weight)] = -1
                for n, i in place.items():
                    if gain.shape[1] and gain[i].max() > best[n][0]:
                        k = int(gain[i].argmax())
                        best[n] = (float(gain[i, k]), f, k, missing_left, lg[i, k], lh[i, k], G[i, 0] - lg[i, k], H[i, 0] - lh[i, k])
        for n, found in best.items():
            if found[0] <= 0:
                continue
            gain, f, k, missing_left, lg, lh, rg, rh = found
            left, right = add(lg, lh), add(rg, rh)
            for name, v in zip(t, (left, right, f, b.cuts[f][k], missing_left, gain)):
                t[name][n] = v
            mine = node == n
            x = b.of[rows[mine], f]
            node[mine] = np.where(np.where(x == b.width - 1, missing_left, x <= k), left, right)
            grown += [left, right]
        open_ = grown
        if not open_:
            break
    kinds = (np.int64, np.int64, np.int64, np.float32, bool, float)
    return {k: np.array(v, d) for (k, v), d in zip(t.items(), kinds)}


def fit(x: np.ndarray, y: np.ndarray, names: Sequence[str], s: Settings, weight: float = 1.0, held: tuple[np.ndarray, np.ndarray] | None = None, rounds: int | None = None) -> Booster:
    """Boosted trees for a 0/1 target; presences weigh ``weight``. With held rows: until their AUC hasn't grown for ``patience`` rounds, cut back to the best."""
    rng, b = np.random.default_rng(s.seed), Binned(x, s.bins)
    w = np.where(y > 0, weight, 1.0)
    model, z = Booster(list(names), 0.0, []), np.zeros(len(y))
    zh, best, best_n = np.zeros(len(held[1])) if held else None, -1.0, 0
    for _ in range(rounds or s.rounds):
        p = 1 / (1 + np.exp(-z))
        rows = np.flatnonzero(rng.random(len(y)) < s.rows)
        cols = np.sort(rng.permutation(x.shape[1])[: max(1, round(s.columns * x.shape[1]))])
        tree = _tree(b, rows, cols, w * (p - y), w * p * (1 - p), s)
        one = Booster(model.features, 0.0, [tree])
        model.trees.append(tree)
        z += one.margins(x)
        if held:
            zh += one.margins(held[0])
            if (now := auc(held[1], zh)) > best:
                best, best_n = now, len(model.trees)
            elif len(model.trees) - best_n >= s.patience:
                break
    if held:
        del model.trees[best_n:]
    return model


def train_group(rows: pd.DataFrame, features: Sequence[str], y: str, block: str, s: Settings) -> dict:
    """Mean AUC over the usable folds, trees of the final fit (median of the folds, least_trees at least), and the model's JSON; no model without a usable fold."""
    x, t = rows[list(features)].to_numpy(np.float32), rows[y].to_numpy(float)
    s = s.for_rows(len(t))
    counts = rows.groupby(block)[y].agg(lambda v: (int((v == 0).sum()), int((v > 0).sum()))).to_dict()
    fold = rows[block].map(stratified_folds(counts, s.folds)).to_numpy()
    weight = float(np.clip((t == 0).sum() / max(1, (t > 0).sum()), 1, 50))
    scores, trees = [], []
    folds = np.unique(fold[~pd.isna(fold)])
    for f in folds:
        held = fold == f
        if len(np.unique(t[held])) < 2 or len(np.unique(t[~held])) < 2:
            continue
        m = fit(x[~held], t[~held], features, s, weight, (x[held], t[held]))
        scores.append(auc(t[held], m.margins(x[held])))
        trees.append(len(m.trees))
    n = max(int(np.median(trees)), s.least_trees) if trees else 0
    model = fit(x, t, features, s, weight, rounds=n).to_json() if n else None
    return {"auc": float(np.mean(scores)) if scores else None, "n_trees": n, "n_usable": len(scores), "n_folds": len(folds), "n_rows": len(t), "model": model}


def train_species(rows: DataFrame, features: Sequence[str], species: str = "species", y: str = "y", block: str = "block", key: str = "cell_id", most: int = 25_000, s: Settings = Settings()) -> DataFrame:
    """(species, auc, n_trees, n_usable, n_folds, n_rows, model) of every species, trained in parallel.

    A species with more presences or background rows than ``most`` is trained on those of the smallest hashed keys, as the models of this kind are. Missing
    features are followed, not dropped; a species of one class, or of one block, has no model.
    """
    order = Window.partitionBy(species, F.col(y) > 0).orderBy(hashed_uniform(F.col(key)), key)
    kept = rows.where(F.col(y).isNotNull() & F.col(block).isNotNull()).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most)
    kind = rows.schema[species].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{species: group[species].iloc[0], **train_group(group.sort_values(key, ignore_index=True), features, y, block, s)}])

    src = kept.select(species, F.col(y).cast("int").alias(y), block, key, *[F.col(f).cast("double").alias(f) for f in features])
    return src.groupBy(species).applyInPandas(run, f"{species} {kind}, auc double, n_trees int, n_usable int, n_folds int, n_rows int, model string")

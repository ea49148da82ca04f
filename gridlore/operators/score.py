"""Scoring of saved models in Arrow batches, and training with MLlib or numpy."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Booster:
    """A gradient-boosted tree ensemble as node arrays: missing values follow default_left, a leaf's value stands in its threshold."""

    features: list[str]
    margin: float
    trees: list[dict[str, np.ndarray]]

    @classmethod
    def from_json(cls, text: str, features: Sequence[str] | None = None) -> Booster:
        """The ensemble's usual JSON; base_score is a probability (as text, perhaps in brackets), the margin starts at its logit."""
        learner = json.loads(text)["learner"]
        raw = learner["learner_model_param"]["base_score"]
        p = float(str(raw).strip("[]").split(",")[0])
        trees = [{"left": np.array(t["left_children"]), "right": np.array(t["right_children"]), "feature": np.array(t["split_indices"]), "at": np.array(t["split_conditions"], np.float32), "default_left": np.array(t["default_left"]).astype(bool), "gain": np.array(t["loss_changes"])} for t in learner["gradient_booster"]["model"]["trees"]]
        names = list(features or learner.get("feature_names") or [f"f{i}" for i in range(int(learner["learner_model_param"]["num_feature"]))])
        return cls(names, float(np.log(p / (1 - p))), trees)

    def to_json(self) -> str:
        """The text that from_json reads."""
        trees = [{"left_children": t["left"].tolist(), "right_children": t["right"].tolist(), "split_indices": t["feature"].tolist(), "split_conditions": [float(v) for v in t["at"]], "default_left": [int(v) for v in t["default_left"]], "loss_changes": [float(v) for v in t["gain"]]} for t in self.trees]
        base = 1 / (1 + np.exp(-self.margin))
        return json.dumps({"learner": {"learner_model_param": {"base_score": repr(float(base)), "num_feature": str(len(self.features))}, "feature_names": self.features, "gradient_booster": {"model": {"trees": trees}}}})

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of rows (float32, NaN missing)."""
        return 1 / (1 + np.exp(-self.margins(x)))

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log odds: all rows walk a tree together."""
        x = np.asarray(x, np.float32)
        out = np.full(len(x), self.margin)
        for t in self.trees:
            node = np.zeros(len(x), np.int64)
            while (go := t["left"][node] >= 0).any():
                n = node[go]
                v = x[go, t["feature"][n]]
                left = np.where(np.isnan(v), t["default_left"][n], v < t["at"][n])
                node[go] = np.where(left, t["left"][n], t["right"][n])
            out += t["at"][node]
        return out

    def importance(self) -> dict[str, float]:
        """Total gain by feature."""
        gain: dict[str, float] = {}
        for t in self.trees:
            inner = t["left"] >= 0
            for f, g in zip(t["feature"][inner], t["gain"][inner]):
                gain[self.features[f]] = gain.get(self.features[f], 0.0) + float(g)
        return gain


@dataclass
class Network:
    """A perceptron on standardised features, residual in its hidden layers: log intensities of all species in one pass."""

    features: list[str]
    mean: np.ndarray
    sd: np.ndarray
    first: tuple[np.ndarray, np.ndarray]
    hidden: list[tuple[np.ndarray, np.ndarray]]
    last: tuple[np.ndarray, np.ndarray]
    species: list[str]
    log_z: np.ndarray

    def to_json(self) -> str:
        """One text with all parameters, which from_json reads."""
        plain = lambda v: v.tolist() if isinstance(v, np.ndarray) else [plain(x) for x in v] if isinstance(v, (list, tuple)) else v
        return json.dumps({"format": 1, **{k: plain(v) for k, v in vars(self).items()}})

    @classmethod
    def from_json(cls, text: str) -> Network:
        d = json.loads(text)
        if d.pop("format", None) != 1:
            raise ValueError("not a network of this format")
        pair = lambda p: (np.array(p[0], float), np.array(p[1], float))
        return cls(d["features"], np.array(d["mean"]), np.array(d["sd"]), pair(d["first"]), [pair(h) for h in d["hidden"]], pair(d["last"]), d["species"], np.array(d["log_z"]))

    def standardise(self, x: np.ndarray) -> np.ndarray:
        """Missing values become zero, the mean."""
        z = (np.asarray(x, np.float64) - self.mean) / self.sd
        return np.where(np.isfinite(z), z, 0.0)

    def intensity(self, x: np.ndarray) -> np.ndarray:
        h = self.standardise(x) @ self.first[0] + self.first[1]
        for w, b in self.hidden:
            h = h + np.maximum(h @ w + b, 0)
        return h @ self.last[0] + self.last[1]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intensity(x) - self.log_z)))

    def sensitivity(self, x: np.ndarray, species: int) -> np.ndarray:
        """Absolute gradient of a species' intensity by each standardised feature."""
        h = self.standardise(x) @ self.first[0] + self.first[1]
        on = []
        for w, b in self.hidden:
            a = h @ w + b
            on.append(a > 0)
            h = h + np.maximum(a, 0)
        g = np.repeat(self.last[0][:, species][None, :], len(h), 0)
        for (w, _), o in zip(reversed(self.hidden), reversed(on)):
            g = g + (g * o) @ w.T
        return np.abs(g @ self.first[0].T)


def _losses(z: np.ndarray, y: np.ndarray, kind: str, mask: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Loss and its gradient by the log intensities (cells x species); with a mask (bce only) over the known pairs of cell and species."""
    if kind == "deepmaxent":
        e = np.exp(z - z.max(axis=0))
        p = e / e.sum(axis=0)
        total = y.sum(axis=0)
        return float(-(y * np.log(p + 1e-300)).mean()), (p * total - y) / y.size
    if kind == "poisson":
        return float((np.exp(z) - y * z).mean()), (np.exp(z) - y) / y.size
    if kind == "ce":
        e = np.exp(z - z.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        return float(-(y * np.log(p + 1e-300)).sum(axis=1).mean()), (p * y.sum(axis=1, keepdims=True) - y) / len(y)
    y = (y > 0).astype(float)
    p = 1 / (1 + np.exp(-z))
    known = np.ones_like(y) if mask is None else mask.astype(float)
    n = max(1.0, known.sum())
    return float(-(known * (y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))).sum() / n), known * (p - y) / n


def mean_auc(y: np.ndarray, z: np.ndarray, mask: np.ndarray | None = None) -> float:
    """Mean over species with both classes among the known cells; 0.5 if there is none."""
    out = []
    for k in range(y.shape[1]):
        known = np.ones(len(y), bool) if mask is None else mask[:, k].astype(bool)
        pos = y[known, k] > 0
        if 0 < pos.sum() < len(pos):
            ranks = pd.Series(z[known, k]).rank().to_numpy()
            out.append((ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum()))
    return float(np.mean(out)) if out else 0.5


def train_network(x: np.ndarray, y: np.ndarray, features: Sequence[str], species: Sequence[str], hidden: int = 32, layers: int = 1, epochs: int = 100, rate: float = 1e-2, decay: float = 2e-5, kind: str = "deepmaxent", seed: int = 0, mask: np.ndarray | None = None, held: tuple | None = None, patience: int = 10) -> Network:
    """Adam with decoupled decay on the whole table of one task; the epoch of the least training loss is kept.

    mask: pairs of cell and species that are known (kind bce). held: (x, y, mask or None) to stop by: the epoch of the best mean AUC there is kept, and training
    ends when it hasn't grown for ``patience`` epochs.
    """
    rng = np.random.default_rng(seed)
    mean, sd = np.nanmean(x, axis=0), np.nanstd(x, axis=0)
    sd = np.where(sd < 1e-8, 1.0, sd)
    init = lambda a, b: [rng.normal(0, (1 / a) ** 0.5, (a, b)), np.zeros(b)]
    parts = [init(x.shape[1], hidden), *[init(hidden, hidden) for _ in range(layers)], init(hidden, y.shape[1])]
    flat = [p for pair in parts for p in pair]
    m, v = [np.zeros_like(p) for p in flat], [np.zeros_like(p) for p in flat]
    z0 = np.where(np.isfinite(q := (x - mean) / sd), q, 0.0)
    best, kept, since = np.inf, [p.copy() for p in flat], 0
    for step in range(1, epochs + 1):
        hs, acts = [z0 @ flat[0] + flat[1]], []
        for k in range(layers):
            a = hs[-1] @ flat[2 + 2 * k] + flat[3 + 2 * k]
            acts.append(a > 0)
            hs.append(hs[-1] + np.maximum(a, 0))
        loss, g = _losses(hs[-1] @ flat[-2] + flat[-1], y, kind, mask)
        if held:
            now = Network(list(features), mean, sd, (flat[0], flat[1]), [(flat[2 + 2 * k], flat[3 + 2 * k]) for k in range(layers)], (flat[-2], flat[-1]), list(species), np.zeros(y.shape[1]))
            loss = -mean_auc(held[1], now.intensity(held[0]), held[2])
        if loss < best:
            best, kept, since = loss, [p.copy() for p in flat], 0
        elif held and (since := since + 1) >= patience:
            break
        grads = [None] * len(flat)
        grads[-2], grads[-1] = hs[-1].T @ g, g.sum(axis=0)
        g = g @ flat[-2].T
        for k in reversed(range(layers)):
            ga = g * acts[k]
            grads[2 + 2 * k], grads[3 + 2 * k] = hs[k].T @ ga, ga.sum(axis=0)
            g = g + ga @ flat[2 + 2 * k].T
        grads[0], grads[1] = z0.T @ g, g.sum(axis=0)
        for i, gi in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * gi, 0.999 * v[i] + 0.001 * gi * gi
            flat[i] = flat[i] * (1 - rate * decay) - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(list(features), mean, sd, (kept[0], kept[1]), [(kept[2 + 2 * k], kept[3 + 2 * k]) for k in range(layers)], (kept[-2], kept[-1]), list(species), np.zeros(y.shape[1]))
    lam = net.intensity(x)
    top = lam.max(axis=0)
    net.log_z = np.log(np.exp(lam - top).sum(axis=0)) + top - np.log(len(lam))
    return net


def score(cells: DataFrame, model: Booster | Network, features: Sequence[str], out: str = "p", keep: Sequence[str] = ("cell_id",)) -> DataFrame:
    """Scores of cells in Arrow batches, the model sent once; a network gives an array over its species. A reordered feature list is refused."""
    if list(features) != list(model.features):
        raise ValueError("the features aren't those of the model, in its order")
    shared = cells.sparkSession.sparkContext.broadcast(model)
    many = isinstance(model, Network)

    def run(batches):
        for b in batches:
            x = np.column_stack([b.column(f"_x{i}").to_numpy(zero_copy_only=False).astype(np.float64) for i in range(len(features))])
            p = shared.value.predict(x)
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], pa.array(list(p) if many else p, pa.list_(pa.float64()) if many else pa.float64())], names=[*keep, out])

    src = cells.select(*keep, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields[: len(keep)])
    return src.mapInArrow(run, f"{kinds}, {out} {'array<double>' if many else 'double'}")


def booster_parameters(n):
    """Regularisation by the number of samples: depth, least child weight, gamma, lambda."""
    p = lambda d, w, g, l: F.struct(F.lit(d).alias("max_depth"), F.lit(w).alias("min_child_weight"), F.lit(g).alias("gamma"), F.lit(l).alias("reg_lambda"))  # noqa: E731, E741
    return F.when(n < 400, p(4, 4, 0.5, 3.0)).when(n < 2000, p(5, 6, 0.8, 4.0)).otherwise(p(5, 10, 1.0, 5.0))


def train_gbt(rows: DataFrame, features: Sequence[str], y: str = "y", rounds: int = 20, depth: int = 3, seed: int = 42, validation: str | None = None):
    """Gradient-boosted trees of one species on rows without nulls; presences weigh as others over presences. validation: a boolean column for early stopping."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    whole = rows.dropna(subset=list(features))
    n = whole.agg(F.sum(y), F.count("*")).first()
    w = (n[1] - n[0]) / n[0] if n[0] else 1.0
    data = VectorAssembler(inputCols=list(features), outputCol="_v").transform(whole.withColumn("_w", F.when(F.col(y) > 0, float(w)).otherwise(1.0)).withColumn(y, F.col(y).cast("double")))
    gbt = GBTClassifier(featuresCol="_v", labelCol=y, weightCol="_w", maxIter=rounds, maxDepth=depth, seed=seed)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return gbt.fit(data)


def logistic(rows: pd.DataFrame, features: Sequence[str], y: str = "y", iterations: int = 1500, ridge: float = 1e-3, rate: float = 1.0) -> np.ndarray:
    """Weights, the intercept first, of a logistic regression by plain gradient descent on a small table."""
    x = np.column_stack([np.ones(len(rows)), rows[list(features)].to_numpy(float)])
    t, w = rows[y].to_numpy(float), np.zeros(len(features) + 1)
    for _ in range(iterations):
        p = 1 / (1 + np.exp(-x @ w))
        w -= rate * (x.T @ (p - t) / len(t) + ridge * np.concatenate([[0], w[1:]]))
    return w

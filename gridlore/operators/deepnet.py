"""Network training over partitions: the whole table takes part in every step, and the driver holds the model alone.

A step of the intensity loss needs each species' sum over all cells, so it makes two passes: the largest log intensity and the scaled sum of each species, then the gradients. Other losses add up
row by row and take one. A pass is a ``mapInArrow`` that gives one model-sized row for each task; where there are many tasks their rows are summed by fewer tasks before the driver gets them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import staged
from .score import Network

#: Tasks whose rows go to the driver as they are.
DIRECT = 32


def _summed(df: DataFrame, part: Callable[[np.ndarray], np.ndarray], join: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """One vector from all rows: part of a batch's matrix, joined within tasks, then across them."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                one = part(np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in b.columns]))
                total = one if total is None else join(total, one)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for v in b.column("v").to_pylist():
                total = np.frombuffer(v) if total is None else join(total, np.frombuffer(v))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    rows = df.mapInArrow(within, "v binary")
    if (n := df.rdd.getNumPartitions()) > DIRECT:
        rows = rows.repartition(int(n**0.5)).mapInArrow(between, "v binary")
    total = None
    for r in rows.collect():  # a row for each task, DIRECT or a root of their number
        total = np.frombuffer(r.v) if total is None else join(total, np.frombuffer(r.v))
    return total


def _scaled(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(maximum, sum of exponentials below it, other sums) of two parts as thirds of a vector."""
    k = len(a) // 3
    top = np.maximum(a[:k], b[:k])
    return np.concatenate([top, a[k : 2 * k] * np.exp(a[:k] - top) + b[k : 2 * k] * np.exp(b[:k] - top), a[2 * k :] + b[2 * k :]])


def _forward(flat: list[np.ndarray], z0: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    hs, on = [z0 @ flat[0] + flat[1]], []
    for k in range(2, len(flat) - 2, 2):
        a = hs[-1] @ flat[k] + flat[k + 1]
        on.append(a > 0)
        hs.append(hs[-1] + np.maximum(a, 0))
    return hs, on, hs[-1] @ flat[-2] + flat[-1]


def _gradients(flat: list[np.ndarray], z0: np.ndarray, hs: list[np.ndarray], on: list[np.ndarray], g: np.ndarray) -> np.ndarray:
    grads = [hs[-1].T @ g, g.sum(axis=0)]
    g = g @ flat[-2].T
    for k in range(len(on) - 1, -1, -1):
        own = g * on[k]
        grads = [hs[k].T @ own, own.sum(axis=0), *grads]
        g = g + own @ flat[2 + 2 * k].T
    return np.concatenate([x.ravel() for x in (z0.T @ g, g.sum(axis=0), *grads)])


def fit_network(cells: DataFrame, features: Sequence[str], species: Sequence[str], hidden: int = 32, layers: int = 1, epochs: int = 100, rate: float = 1e-2, decay: float = 2e-5, kind: str = "deepmaxent", seed: int = 0) -> Network:
    """The network that ``score.train_network`` gives on the same rows, but for the order of sums: Adam with decoupled decay, the epoch of the least loss is kept.

    features: columns of numbers, null or NaN where missing; species: columns of counts or labels, a null one (kind "bce" only) unknown. kind: "deepmaxent", "poisson" or "bce".
    """
    if kind not in ("deepmaxent", "poisson", "bce"):
        raise ValueError(f"no loss {kind}")
    n_f, n_s, spark = len(features), len(species), cells.sparkSession
    table = staged(cells.select(*(F.col(c).cast("double") for c in (*features, *species))), "training")
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    stats = table.agg(F.count("*"), *(F.avg(known(c)) for c in features), *(F.stddev_pop(known(c)) for c in features)).first()
    rows = stats[0]
    if not rows:
        raise ValueError("no cells to learn from")
    number = lambda v: np.array([np.nan if x is None else x for x in v])
    mean, sd = number(stats[1 : 1 + n_f]), number(stats[1 + n_f :])
    sd = np.where(sd < 1e-8, 1.0, sd)
    rng = np.random.default_rng(seed)
    init = lambda a, b: [rng.normal(0, (1 / a) ** 0.5, (a, b)), np.zeros(b)]
    flat = [p for pair in (init(n_f, hidden), *(init(hidden, hidden) for _ in range(layers)), init(hidden, n_s)) for p in pair]
    shapes, sizes = [p.shape for p in flat], [p.size for p in flat]

    def parts(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = (m[:, :n_f] - mean) / sd
        return np.where(np.isfinite(z), z, 0.0), m[:, n_f:]

    def sums_of(shared):
        def part(m):
            z0, y = parts(m)
            z = _forward(shared.value, z0)[2]
            top = z.max(axis=0)
            return np.concatenate([top, np.exp(z - top).sum(axis=0), y.sum(axis=0)])

        return _summed(table, part, _scaled)

    def step(shared, log_z, totals):
        def part(m):
            z0, y = parts(m)
            hs, on, z = _forward(shared.value, z0)
            if kind == "deepmaxent":
                log_p = z - log_z
                loss, g, n = -(y * np.maximum(log_p, np.log(1e-300))).sum(), np.exp(log_p) * totals - y, y.size
            elif kind == "poisson":
                loss, g, n = (np.exp(z) - y * z).sum(), np.exp(z) - y, y.size
            else:
                there = np.isfinite(y)
                own, p = np.where(there, y > 0, 0.0), 1 / (1 + np.exp(-z))
                loss, g, n = -(there * (own * np.log(p + 1e-12) + (1 - own) * np.log(1 - p + 1e-12))).sum(), there * (p - own), there.sum()
            return np.concatenate([[loss, n], _gradients(shared.value, z0, hs, on, g)])

        return _summed(table, part, np.add)

    m, v = [np.zeros_like(p) for p in flat], [np.zeros_like(p) for p in flat]
    best, kept = np.inf, flat
    for t in range(1, epochs + 1):
        shared = spark.sparkContext.broadcast(flat)  # the model
        log_z = totals = None
        if kind == "deepmaxent":
            top, total, totals = np.split(sums_of(shared), 3)
            log_z = np.log(total) + top
        out = step(shared, log_z, totals)
        loss, n = out[0] / max(1.0, out[1]), max(1.0, out[1])
        if loss < best:
            best, kept = loss, [p.copy() for p in flat]
        grads = [x.reshape(s) / n for x, s in zip(np.split(out[2:], np.cumsum(sizes)[:-1]), shapes)]
        for i, g in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
        flat = [p * (1 - rate * decay) - rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8) for p, a, b in zip(flat, m, v)]
        shared.destroy()
    top, total, _ = np.split(sums_of(spark.sparkContext.broadcast(kept)), 3)
    pairs = [(kept[i], kept[i + 1]) for i in range(0, len(kept), 2)]
    return Network(list(features), mean, sd, pairs[0], pairs[1:-1], pairs[-1], list(species), np.log(total) + top - np.log(rows))

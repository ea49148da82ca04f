"""Connected components: links found block by block inside tasks, then large-star / small-star rounds over the edges that remain."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import join_spread, n_seen, rows_seen, shuffles_for, stage, unstage


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node of its component) that connect what the links a-b connect: fewer rows than nodes."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = both[: len(a)], both[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new[label], label):
            break
        label = new[label]
    off = label != np.arange(len(nodes))
    return nodes[off], nodes[label[off]]


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of longs -> (node, root), staged, root the smallest node of the component.

    Each half-round is one aggregate (combined before the shuffle) and one join on the same key, written to the shared folder;
    the rows of a node with very many edges are joined where they are, not in one task. Ends when every node with a
    smaller neighbour has no other one: then the edges are stars around their smallest nodes. The round's first aggregate sees that as it is
    written, so neither the end nor very common nodes take a job of their own. Self-loops and nulls are ignored; repeated edges count once; no edges: no rows.
    """
    spark = edges.sparkSession
    e = stage(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", **rows_seen())
    while True:
        n = e.seen["rows"]
        with shuffles_for(spark, n):
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = stage(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "low", open=F.expr("count_if(m < u and n > 1)"), **n_seen())
            new = _round(both, low, n) if low.seen["open"] else None
        unstage(e)
        if new is None:
            return low.select(F.col("u").alias("node"), F.least("u", "m").alias("root"))
        unstage(low)
        e = new


def _round(both: DataFrame, low: DataFrame, n: int) -> DataFrame:
    # large star: every larger neighbour goes to the smallest of the neighbourhood
    large = join_spread(both.where("v > u"), low, "u", 2 * n).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    # small star: every smaller neighbour, and the node, go to the smallest of them
    mid = stage(large, "large")
    down = stage(mid.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "low", **n_seen())
    small = join_spread(mid, down, "u", n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).distinct()
    new = stage(small, "small", **rows_seen())
    unstage(mid, down)
    return new

"""Embedding near-duplicates by a forest of random-projection trees.

Every tree splits vectors recursively by random projections; near a split a vector goes both ways (spill). Vectors of one
label that share a leaf are compared exactly, in double precision, and those at ``cosine`` or more are linked. Split points come
from a bounded sample (``Settings.sample_rows`` vectors of the smallest hashed class number); every vector is put into every tree. Recall is
measured against brute force in the tests.

Split points below the depth that the sample can tell apart are one number for a level, so the trees stay small however deep they get. A pair is missed only
if every tree parts it; each parts fewer than one pair in two hundred at 0.98 (README), five hold nearly all.

Equal vectors of one label are one class, named by a 128-bit hash of both, and are compared once; every member counts in the number of links. A pair found in several leaves counts in
the smallest leaf number that both share. Tasks emit numbers of links and spanning forests, never pairs. A leaf of more than ``leaf_block``
classes is dealt to tasks as pairs of blocks.

Defined results: vectors that are null, empty, zero, hold nulls or non-finite numbers, or have no label link with nothing and are their own
component; vectors of other lengths never link; repeated rows are equal vectors; a null id keeps its row and is never kept;
an empty table gives no rows. Only the id, vector and label columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, forest
from .shared import join_spread, stage


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.98
    trees: int = 5
    leaf_size: int = 200
    spill: float = 0.1  # how far around a split, as a distance of unit vectors before projection
    sample_rows: int = 8192
    leaf_block: int = 2048
    seed: int = 11


#: Most leaves that may be dealt as blocks; the bound of the broadcast list.
SPLIT_LEAVES = 50_000


class Forest:
    """Directions by tree and level, split points by tree and node (root 1, children 2n and 2n + 1)."""

    def __init__(self, depth: int, s: Settings):
        self.depth, self.s, self.splits = depth, s, {}
        self._directions: dict[int, np.ndarray] = {}

    def directions(self, dim: int) -> np.ndarray:
        if dim not in self._directions:
            r = np.random.default_rng([self.s.seed, dim]).normal(size=(self.s.trees, max(1, self.depth), dim))
            self._directions[dim] = r / np.linalg.norm(r, axis=2, keepdims=True)
        return self._directions[dim]

    def fit(self, unit: np.ndarray) -> None:
        dim = unit.shape[1]
        d = self.directions(dim)
        for t in range(self.s.trees):
            p = unit @ d[t].T
            node = np.ones(len(unit), np.int64)
            for level in range(self.depth):
                whole = float(np.median(p[:, level])) if len(p) else 0.0
                # nodes of too few sample vectors split where all vectors of the sample do; so do all nodes of levels that have no other
                at = np.full(1 << level if len(p) >= 16 << level else 1, whole)
                for n in np.unique(node) if len(at) > 1 else ():
                    own = p[node == n, level]
                    if len(own) >= 16:
                        at[n - (1 << level)] = np.median(own)
                self.splits[dim, t, level] = at
                node = 2 * node + (p[:, level] >= self.split(dim, t, level, node))

    def split(self, dim: int, t: int, level: int, node: np.ndarray) -> np.ndarray | float:
        at = self.splits.get((dim, t, level))
        return 0.0 if at is None else at[0] if len(at) == 1 else at[node - (1 << level)]

    def leaves(self, unit: np.ndarray) -> list[np.ndarray]:
        """Of each vector the leaves that hold it, ascending: tree * 2^40 + node."""
        n, dim = unit.shape
        d, margin = self.directions(dim), self.s.spill / dim**0.5
        rows, found = [], []
        for t in range(self.s.trees):
            p = unit @ d[t].T
            row, node = np.arange(n), np.ones(n, np.int64)
            for level in range(self.depth):
                gap = p[row, level] - self.split(dim, t, level, node)
                right, left = gap >= -margin, gap < margin
                row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
            rows.append(row)
            found.append((np.int64(t) << 40) + node)
        rows, found = np.concatenate(rows), np.concatenate(found)
        order = np.lexsort((found, rows))
        return np.split(found[order], np.cumsum(np.bincount(rows, minlength=n))[:-1])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.values.slice(column.offsets[0].as_py(), column.offsets[-1].as_py() - column.offsets[0].as_py()).to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)  # squares of very small or large numbers stay in range
    x = x / scale
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _first_shared(leaf: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of leaf lists a and b (padded with -1) share no leaf before this one."""
    shared = (a[:, :, None] == b[:, None, :]) & (a >= 0)[:, :, None] & (a < leaf)[:, :, None]
    return ~shared.any(axis=(1, 2))


class _Leaf:
    """Rows of one leaf, or of two of its blocks."""

    def __init__(self, key: tuple):
        self.key, self.parts = key, []

    def compare(self, least: float):
        cls, n, side, unit, lists = (np.concatenate([p[i] for p in self.parts]) if i < 4 else [x for p in self.parts for x in p[4]] for i in range(5))
        leaf, b1, b2 = self.key[2], self.key[3], self.key[4]
        width = max(map(len, lists))
        own = np.full((len(lists), width), -1, np.int64)
        for i, x in enumerate(lists):
            own[i, : len(x)] = x
        x, y = (np.arange(len(cls)),) * 2 if b1 == b2 else (np.flatnonzero(side == b1), np.flatnonzero(side == b2))
        links = np.zeros(len(cls), np.int64)
        sets, sign = np.unique(own, axis=0, return_inverse=True)
        sign = sign.reshape(-1)
        table = None
        us, vs = [], []
        for at in range(0, len(x), 1024):
            xs = x[at : at + 1024]
            near = unit[xs] @ unit[y].T >= least
            if b1 == b2:
                near &= xs[:, None] < y[None, :]
            i, j = np.nonzero(near)
            if not len(i):
                continue
            i, j = xs[i], y[j]
            if len(sets) ** 2 <= len(i):
                if table is None:
                    table = np.stack([_first_shared(leaf, np.repeat(s[None, :], len(sets), 0), sets) for s in sets])
                first = table[sign[i], sign[j]]
            else:
                first = np.concatenate([_first_shared(leaf, own[i[k : k + 20_000]], own[j[k : k + 20_000]]) for k in range(0, len(i), 20_000)])
            i, j = i[first], j[first]
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            if len(i):
                u, v = forest(cls[i], cls[j])
                us.append(u)
                vs.append(v)
        some = np.flatnonzero(links)
        if not len(some):
            return None
        u, v = np.concatenate(us), np.concatenate(vs)
        none = lambda k: pa.nulls(k, pa.int64())
        return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(a), b]) for a, b in ((u, none(len(some))), (v, none(len(some))))] + [pa.concat_arrays([none(len(u)), pa.array(cls[some])]), pa.concat_arrays([none(len(u)), pa.array(links[some])])], names=["u", "v", "cls", "links"])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", s: Settings = Settings()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vec"), F.col(label_col).alias("label"))
    fine = F.coalesce(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0) & F.col("label").isNotNull(), F.lit(False))
    # two hashes of label and vector tell classes apart
    twice = F.concat(F.hex(F.xxhash64("label", "vec")), F.lit("-"), F.hex(F.xxhash64("vec", F.lit(1), "label")))
    good = src.where(fine).withColumn("key", twice)
    by_row = stage(good.select("vec_id", "key"), "rows")
    classes = good.groupBy("key").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.min("vec_id").alias("low"), F.count("*").alias("n"))
    classes = stage(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    largest = classes.groupBy("label", F.size("vec")).count().agg(F.max("count")).first()[0] or 1
    trees = Forest(max(0, int(np.ceil(np.log2(max(1.0, largest / s.leaf_size))))), s)
    sample: dict[int, list] = {}
    for r in classes.select("vec").orderBy(F.xxhash64("cls", "vec")).limit(s.sample_rows).collect():
        sample.setdefault(len(r["vec"]), []).append(r["vec"])
    for rows in sample.values():
        trees.fit(_unit(np.array(rows, np.float64)))
    trees = vectors.sparkSession.sparkContext.broadcast(trees)

    def route(batches):
        for b in batches:
            vec, size = b.column(2), np.diff(b.column(2).offsets.to_numpy())
            for dim in np.unique(size):
                part = b.filter(pa.array(size == dim)) if len(np.unique(size)) > 1 else b
                lists = trees.value.leaves(_unit(_matrix(part.column(2))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lists, pa.list_(pa.int64()))], names=["cls", "n", "vec", "label", "leaves"])

    kind = classes.schema["label"].dataType.simpleString()
    vec_kind = classes.schema["vec"].dataType.simpleString()
    routed = stage(classes.select("cls", "n", "vec", "label").mapInArrow(route, f"cls long, n long, vec {vec_kind}, label {kind}, leaves array<long>"), "routed")
    by_leaf = routed.select("label", F.size("vec").alias("dim"), F.explode("leaves").alias("leaf")).groupBy("label", "dim", "leaf").agg(F.count("*").alias("c"))
    by_leaf = stage(by_leaf, "leaf-sizes")
    total = by_leaf.agg(F.sum("c")).first()[0] or 0
    block = max(s.leaf_block, total // SPLIT_LEAVES)
    hot = F.broadcast(by_leaf.where(F.col("c") > block).select("label", "dim", "leaf", F.ceil(F.col("c") / block).cast("int").alias("blocks")))
    rows = routed.select("cls", "n", "vec", "label", "leaves", F.size("vec").alias("dim"), F.explode("leaves").alias("leaf")).join(hot, ["label", "dim", "leaf"], "left")
    mine = F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("side", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    rows = rows.withColumn("b1", F.least("side", "other")).withColumn("b2", F.greatest("side", "other"))
    keys = ["label", "dim", "leaf", "b1", "b2"]
    # a leaf alone by its number, blocks of a split leaf side by side in any order
    rows = rows.select(*keys, "cls", "n", "side", "vec", "leaves").repartition(*keys).sortWithinPartitions(*keys)

    def compare(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(i).to_pylist() for i in range(5)]
            ks = list(zip(*cols))
            cuts = [0, *(i for i in range(1, len(ks)) if ks[i] != ks[i - 1]), len(ks)]
            cls, n, side = (b.column(i).to_numpy() for i in (5, 6, 7))
            for a, e in zip(cuts, cuts[1:]):
                if held is None or held.key != ks[a]:
                    if held is not None and (out := held.compare(s.cosine)) is not None:
                        yield out
                    held = _Leaf(ks[a])
                offsets, flat = b.column(9).offsets.to_numpy(), b.column(9).values.to_numpy()
                held.parts.append((cls[a:e], n[a:e], side[a:e], _unit(_matrix(b.column(8).slice(a, e - a))), [flat[offsets[i] : offsets[i + 1]] for i in range(a, e)]))
        if held is not None and (out := held.compare(s.cosine)) is not None:
            yield out

    found = stage(rows.mapInArrow(compare, "u long, v long, cls long, links long"), "links")
    links = found.where("cls is not null").groupBy("cls").agg(F.sum("links").alias("links"))
    comp = connected_components(found.where("u is not null").select("u", "v"))
    of_class = classes.select("key", "cls", "low", "n").join(comp.withColumnRenamed("node", "cls"), "cls", "left").join(links, "cls", "left")
    of_class = stage(of_class.select("key", "low", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "cls").alias("root")), "linked")
    low = stage(of_class.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n")), "lowest")
    of_class = join_spread(of_class.withColumnRenamed("n", "rows").drop("low"), low, "root", of_class.count())
    of_class = stage(of_class.select("key", "n_links", "component_id", F.col("rows").alias("n")), "groups")
    linked = join_spread(by_row, of_class, "key", by_row.count()).select("vec_id", "n_links", "component_id")
    alone = src.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))

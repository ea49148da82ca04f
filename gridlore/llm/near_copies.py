"""Near copies by the Jaccard similarity of word shingles: SimHash with multi-index hashing finds them, the shingle sets decide.

The second form of operator 5, for a similarity instead of a number of bits. A text's set holds the XXH64 hashes of its shingles of five words, texts of
equal sets are one class. The fingerprint is the bitwise majority of the shingles' hashes, each stretched to some 64-bit lanes. Of two sets of similarity s a
bit differs with probability p = acos(2s / (1 + s)) / pi, 0.15 for 0.8. A single 64-bit word would need balls of 17 bits to catch these pairs; so the fingerprint is
wide and cut into many segments, each with its table, and a pair is met where one whole segment is equal (the ball of radius 0). The segments' width grows with the
logarithm of the number of documents, so that a table entry keeps a few dozen classes; their number follows from p, so that a pair of exactly
the least similarity is met with probability ``RECALL`` (nearer ones more surely).

Classes that meet are compared by the first two lanes, those that pass by the complete fingerprint: that makes groups, of which tasks emit spanning forests and each
class's nearest one, never all pairs. The nearest pairs are decided first, by the whole sets. Where a group still falls in several components, the classes outside of
its largest one are held against blocks of the group's classes, sets and all, inside tasks, which emit only links that join components. Nothing is capped: an entry or a
group that is too long for a task is dealt in parts.

Defined results: a null text counts as empty; empty texts are one class; a shorter text is one shingle; repeated rows each get a row; texts of which
all ids are null link nothing; an empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components, forest
from .shared import join_spread, n_seen, rows_seen, shuffles_for, stage, unstage
from .simhash import kept_rows

RECALL = 0.999
#: Classes that a table entry should keep on average, and the least width of a segment in bits.
ENTRY_CLASSES, LEAST_WIDTH = 64, 16
#: Classes of one entry that are held against each other in one task, and classes of a group that are asked in one task.
ENTRY_ROWS, BLOCK = 4096, 512
#: Standard deviations beyond the mean distance at the least similarity that the fingerprints may differ.
SLACK = 3.5
#: In sets of a few shingles ties of the majority move the fingerprint more than p says, most of all from four to five: 3 of 8 bits are ties there, of which the fifth turns half.
SMALL_P = 3 / 16
#: Shingles stretched at a time, and pairs compared at a time.
SHINGLES_AT_ONCE, PAIRS_AT_ONCE = 255, 1 << 20


@dataclass(frozen=True)
class Shape:
    """Sizes of fingerprint and tables for a similarity and a number of documents."""

    width: int
    segments: int
    p: float

    @classmethod
    def of(cls, least: float, n: int) -> Shape:
        p = math.acos(2 * least / (1 + least)) / math.pi
        width = min(40, max(LEAST_WIDTH, math.ceil(math.log2(max(1, n) / ENTRY_CLASSES))))
        return cls(width, math.ceil(math.log(1 - RECALL) / math.log1p(-((1 - p) ** width))), p)

    @property
    def lanes(self) -> int:
        return max(2, -(-self.width * self.segments // 64))

    def radius(self, bits: int) -> int:
        """Most bits in which a pair of the least similarity differs, surely enough; whole sets decide later, so a wide one loses nothing."""
        p = max(self.p, SMALL_P)
        return math.floor(bits * p + SLACK * math.sqrt(bits * p * (1 - p)))

    def key(self, i: int, fp: Column) -> Column:
        """Segment i of the lanes and its number, as one long."""
        word, shift = divmod(i * self.width, 64)
        low = F.shiftrightunsigned(fp[word], shift)
        if shift + self.width > 64:
            low = low.bitwiseOR(F.shiftleft(fp[word + 1], 64 - shift))
        return low.bitwiseAND(F.lit((1 << self.width) - 1).cast("long")) + F.lit(i << self.width).cast("long")


def shingles(text: str | None, shingle_words: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct shingle hashes in order. Lower-cases A-Z only; words end at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(shingle_words, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist())), np.uint64, len(starts)))


def class_of(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes())


def _mixers(lanes: int) -> tuple[np.ndarray, np.ndarray]:
    xor, times = np.random.default_rng(42).integers(0, 1 << 64, (lanes, 2), np.uint64).T
    return xor.copy(), times | np.uint64(1)


def fingerprint(own: np.ndarray, mixers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The majority of the hashes' bits in each lane, as 64-bit words; no words for an empty set."""
    if not len(own):
        return np.zeros(0, np.uint64)
    xor, times = mixers
    count = np.zeros(64 * len(xor), np.int64)
    for at in range(0, len(own), SHINGLES_AT_ONCE):
        h = (own[at : at + SHINGLES_AT_ONCE, None] ^ xor) * times
        h ^= h >> np.uint64(32)
        h *= times
        h ^= h >> np.uint64(29)
        count += np.add.reduce(np.unpackbits(h.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * count > len(own)).view(np.uint64)


def _lists(rows: list) -> pa.Array:
    flat = np.concatenate([np.zeros(0, np.uint64), *(np.asarray(r, np.uint64) for r in rows)])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(flat.view(np.int64)))


def sketches(docs: DataFrame, lanes: int, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, seed: int = 42) -> DataFrame:
    """(id, node, fp): a row for each row of docs, node its class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixers = _mixers(lanes)
        for b in batches:
            sets = (shingles(t.as_py(), shingle_words, seed) for t in b.column(1))
            both = [(class_of(s), fingerprint(s, mixers)) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array([c for c, _ in both], np.uint64).view(np.int64)), _lists([k for _, k in both])], names=["id", "node", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, node long, fp array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle_words: int, seed: int) -> DataFrame:
    """(node, own): the whole sets of the wanted (id, node), read from the texts again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = [(n, s) for n, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if class_of(s := shingles(t, shingle_words, seed)) == n % (1 << 64)]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.int64()), _lists([s for _, s in rows])], names=["node", "own"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(wanted, "id").select("node", "text")
    return src.mapInArrow(run, "node long, own array<long>").dropDuplicates(["node"])


def _entries(batches: Iterator[pa.RecordBatch], n_keys: int, most: int) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Rows sorted by their first n_keys columns -> batches that hold whole keys, and whether a key is too long for that (then some of its rows)."""
    held: list[pa.RecordBatch] = []
    long_key = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([*held, b]).combine_chunks().to_batches()[0]
        keys = np.stack([t.column(i).to_numpy() for i in range(n_keys)])
        if long_key is not None:
            n = int(np.argmin(np.append((keys == long_key[:, None]).all(axis=0), False)))
            if n:
                yield t.slice(0, n), True
            if n == t.num_rows:
                continue
            t, keys, long_key = t.slice(n), keys[:, n:], None
        same = (keys == keys[:, -1:]).all(axis=0)
        last = t.num_rows - int(np.argmin(np.append(same[::-1], False)))
        if last:
            yield t.slice(0, last), False
        held = [t.slice(last)]
        if held[0].num_rows > most:
            yield held[0], True
            long_key, held = keys[:, -1], []
    if held:
        yield held[0], False


def _met(radius: int, most: int):
    """Rows (key, node, a, b) sorted by key -> the rows that have a near one in their entry; rows of very long entries all pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, long_one in _entries(batches, 1, most):
            if not long_one:
                key, x, y = b.column(0).to_numpy(), b.column(2).to_numpy().view(np.uint64), b.column(3).to_numpy().view(np.uint64)
                near, at, d = np.zeros(len(key), bool), np.arange(len(key) - 1), 1
                while len(at := at[at + d < len(key)]) and len(at := at[key[at] == key[at + d]]):
                    hit = at[np.bitwise_count(x[at] ^ x[at + d]).astype(np.int16) + np.bitwise_count(y[at] ^ y[at + d]) <= radius]
                    near[hit] = near[hit + d] = True
                    d += 1
                b = b.filter(pa.array(near))
            if b.num_rows:
                yield b

    return run


def _cuts(b: pa.RecordBatch, n_keys: int) -> list[tuple[int, int]]:
    keys = np.stack([b.column(i).to_numpy() for i in range(n_keys)])
    at = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
    return list(zip([0, *at.tolist()], [*at.tolist(), b.num_rows]))


def _matrix(c: pa.Array) -> np.ndarray:
    return c.flatten().to_numpy().view(np.uint64).reshape(len(c), -1)


def _apart(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row of x, distances of some rows of x to all of y)."""
    step = max(1, PAIRS_AT_ONCE // max(1, len(y)))
    for at in range(0, len(x), step):
        d = np.zeros((len(x[at : at + step]), len(y)), np.int32)
        for lane in range(x.shape[1]):
            d += np.bitwise_count(x[at : at + step, lane, None] ^ y[None, :, lane])
        yield at, d


def _near(radius: int):
    """Rows (key, part, asks, node, fp), those that ask last -> (u, v, d): each class with its nearest, if near, and without d edges that connect all near pairs (of one that asks, if any does)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _ in _entries(batches, 2, 1 << 62):
            for lo, hi in _cuts(b, 2):
                asks = b.column(2).to_numpy(zero_copy_only=False).astype(bool)[lo:hi]
                node, fp = b.column(3).to_numpy()[lo:hi], _matrix(b.column(4).slice(lo, hi - lo))
                y = np.flatnonzero(~asks)
                x = np.flatnonzero(asks) if asks.any() else y
                us, vs, nearest = [], [], []
                for at, d in _apart(fp[x], fp[y]):
                    d[node[x[at : at + len(d)], None] == node[y][None, :]] = 1 << 30
                    i, j = np.nonzero(d <= radius)
                    if len(i):
                        u, v = forest(node[x[at + i]], node[y[j]])
                        us.append(u)
                        vs.append(v)
                        i = np.unique(i)
                        j = d[i].argmin(axis=1)
                        nearest.append((node[x[at + i]], node[y[j]], d[i, j]))
                if us:
                    u, v = forest(np.concatenate(us), np.concatenate(vs))
                    cols = [np.concatenate([a, *(n[k] for n in nearest)]) for k, a in enumerate((u, v, np.full(len(u), -1)))]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["u", "v", "d"])

    return run


class _Block:
    """Classes of a group with their components and sets."""

    def __init__(self, key: tuple[int, int]):
        self.key, self.rows, self.made = key, [], False

    def close(self) -> None:
        self.node, self.comp = (np.array([r[k] for r in self.rows], np.int64) for k in (0, 1))
        self.fp, own = np.stack([r[2] for r in self.rows]), [r[3] for r in self.rows]
        self.size = np.array([len(x) for x in own])
        flat, of = np.concatenate(own), np.repeat(np.arange(len(own)), self.size)
        order = np.argsort(flat, kind="stable")
        self.flat, self.of, self.made, self.rows = flat[order], of[order], True, []
        self.joined: dict[int, int] = {}

    def label(self, comp: int) -> int:
        while comp in self.joined:
            comp = self.joined[comp]
        return comp

    def ask(self, rows: list, radius: int, least: float) -> list[tuple[int, int]]:
        """Links of the asking rows with classes of other components, as many as it takes to join what they join."""
        out = []
        for at, d in _apart(np.stack([r[2] for r in rows]), self.fp):
            for (node, comp, _, own), near in zip(rows[at : at + len(d)], d <= radius):
                mine = self.label(comp)
                y = np.flatnonzero(near & (self.comp != mine))
                if not len(y):
                    continue
                common = np.zeros(len(self.size), np.int64)
                lo, hi = np.searchsorted(self.flat, own, "left"), np.searchsorted(self.flat, own, "right")
                for a, e in zip(lo.tolist(), hi.tolist()):
                    common[self.of[a:e]] += 1  # a set has a shingle once
                y = y[common[y] >= least * (len(own) + self.size[y] - common[y])]
                for c in np.unique(self.comp[y]).tolist():
                    out.append((node, int(self.node[y[self.comp[y] == c][0]])))
                    self.joined[c] = mine
                    self.comp[self.comp == c] = mine
        return out


def _across(radius: int, least: float):
    """Rows (grp, block, asks, node, comp, fp, own) sorted by the first three -> links (u, v) that join components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block((0, 0))
        for b in batches:
            if not b.num_rows:
                continue
            grp, part, asks, node, comp = (b.column(k).to_pylist() for k in range(5))
            fp, own, links = _matrix(b.column(5)), b.column(6), []
            waiting: list = []
            for i in range(b.num_rows + 1):
                ends = i == b.num_rows or (grp[i], part[i]) != block.key
                if waiting and (ends or len(waiting) == 256):
                    links += block.ask(waiting, radius, least)
                    waiting = []
                if i == b.num_rows:
                    break
                if ends:
                    block = _Block((grp[i], part[i]))
                row = node[i], comp[i], fp[i], own[i].values.to_numpy().view(np.uint64).copy()
                if not asks[i]:
                    block.rows.append((*row[:2], fp[i].copy(), row[3]))
                elif block.made or block.rows:
                    if not block.made:
                        block.close()
                    waiting.append(row)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v), staged with rows_seen, whose whole sets reach the similarity."""
    n = pairs.seen["rows"]
    for c in ("u", "v"):
        own = stage(pairs.groupBy(F.col(c).alias("node")).agg(F.count("*").alias("n")).join(sets, "node").select(F.col("node").alias(c), F.col("own").alias(f"s{c}"), "n"), "asked", **n_seen())
        pairs = join_spread(pairs, own, c, n)
    common = F.size(F.array_intersect("su", "sv"))
    near = pairs.select("u", "v", common.alias("c"), (F.size("su") + F.size("sv")).alias("n")).where(F.col("c") >= F.lit(least) * (F.col("n") - F.col("c")))
    return near.select("u", "v")


def _parts(rows: DataFrame, key: str, node: str, asks: Column, limit: int) -> DataFrame:
    """rows dealt by key in parts of about limit rows, each row once as one that is asked; rows for which asks holds also ask each part. Adds part and asks."""
    sizes = stage(rows.groupBy(key).agg(F.ceil(F.count("*") / limit).alias("parts")).where("parts > 1"), "long", **rows_seen())
    if sizes.seen["rows"]:
        rows = rows.join(F.broadcast(sizes), key, "left")
    else:
        rows = rows.withColumn("parts", F.lit(1).cast("long"))
    rows = rows.withColumn("parts", F.coalesce("parts", F.lit(1)))  # sizes: keys with more than limit rows: fewer than the rows by that factor
    asked = rows.withColumns({"part": F.pmod(F.xxhash64(node), F.col("parts")), "asks": F.lit(False)})
    asking = rows.where(asks).withColumns({"part": F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)), "asks": F.lit(True)})
    return asked.unionByName(asking).drop("parts")


def _roots(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, seed: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(by_doc, classes): id and node of each row; node, low, n, root of each class, low the smallest id of its rows and n how many have it."""
    shape = Shape.of(least, docs.count())
    radius = shape.radius(64 * shape.lanes)
    by_doc = stage(sketches(docs, shape.lanes, id_col, text_col, shingle_words, seed), "sketches")
    classes = stage(by_doc.groupBy("node").agg(F.min("id").alias("low"), F.count("*").alias("n"), F.first("fp").alias("fp")), "classes")
    found = classes.where("low is not null and size(fp) > 0")
    keys = F.array(*[shape.key(i, F.col("fp")) for i in range(shape.segments)])
    rows = found.select(F.explode(keys).alias("key"), "node", F.col("fp")[0].alias("a"), F.col("fp")[1].alias("b"))
    met = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_met(shape.radius(128), ENTRY_ROWS), "key long, node long, a long, b long").select("key", "node")
    met = stage(met.join(classes.select("node", "fp"), "node").select("key", "node", "fp"), "met", **rows_seen())

    def near_of(dealt: DataFrame) -> DataFrame:
        rows = dealt.select("key", "part", "asks", "node", "fp").repartition("key", "part").sortWithinPartitions("key", "part", "asks")
        return stage(rows.mapInArrow(_near(radius), "u long, v long, d long").groupBy("u", "v").agg(F.max("d").alias("d")), "near", **rows_seen())

    with shuffles_for(docs.sparkSession, met.seen["rows"], 20_000):
        near = near_of(_parts(met, "key", "node", F.lit(False), ENTRY_ROWS))
        long = met.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > ENTRY_ROWS)
        long = stage(met.join(F.broadcast(long.drop("c")), "key"), "long-entries", **rows_seen())  # keys with more than ENTRY_ROWS rows: fewer than the rows by that factor
        if long.seen["rows"]:
            # parts of an entry were held against themselves; what is outside of the entry's largest group now asks all parts
            grp = connected_components(near.select("u", "v"))
            long = stage(long.join(grp, "node", "left").withColumn("grp", F.coalesce("root", "node")).drop("root"), "grouped")
            main = long.groupBy("key", "grp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("grp", F.struct("c", "grp")).alias("main"))
            dealt = _parts(long.join(F.broadcast(main), "key"), "key", "node", F.col("grp") != F.col("main"), ENTRY_ROWS)
            near = stage(near.unionByName(near_of(dealt)), "near", **rows_seen())
    with shuffles_for(docs.sparkSession, near.seen["rows"]):
        groups = connected_components(near.select("u", "v"))
        wanted = stage(classes.select("node", F.col("low").alias("id"), "fp").join(groups, "node"), "members")
        sets = stage(_sets(docs, wanted.select("node", "id"), id_col, text_col, shingle_words, seed), "sets")
        first = near.where("d >= 0").groupBy("u").agg(F.min_by("v", F.struct("d", "v")).alias("v"))
        pairs = stage(first.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs", **rows_seen())
        stars = lambda c: c.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
        comp = connected_components(_verified(pairs, sets, least))
        # groups in several components: what is outside of the largest is held against all
        at = stage(wanted.withColumnRenamed("root", "grp").join(comp, "node", "left").select("grp", "node", "fp", F.coalesce("root", "node").alias("comp")), "at")
        main = at.groupBy("grp", "comp").agg(F.count("*").alias("c")).groupBy("grp").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("c").alias("n"), F.count("*").alias("comps"))
        main = stage(main.where("comps > 1").drop("comps"), "main", **n_seen())
        if main.seen["rows"]:
            mixed = join_spread(at, main, "grp", main.seen["total"])
            dealt = _parts(stage(mixed.join(sets, "node"), "mixed"), "grp", "node", F.col("comp") != F.col("main"), BLOCK).select("grp", "part", "asks", "node", "comp", "fp", "own")
            more = dealt.repartition("grp", "part").sortWithinPartitions("grp", "part", "asks").mapInArrow(_across(radius, least), "u long, v long")
            comp = connected_components(stars(comp).unionByName(more))
    out = stage(classes.join(comp, "node", "left").select("node", "low", "n", F.coalesce("root", "node").alias("root")), "roots")
    unstage(met, sets)
    return by_doc, out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, seed: int = 42, least: float = 0.8) -> DataFrame:
    """(id, component_id): a row for each row of docs, component_id the smallest id that links of at least that similarity reach."""
    by_doc, classes = _roots(docs, id_col, text_col, shingle_words, seed, least)
    low = stage(classes.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n")), "lowest")
    of_class = join_spread(classes.select("node", F.col("n").alias("rows"), "root"), low, "root", classes.count())
    of_class = stage(of_class.select("node", "component_id", F.col("rows").alias("n")), "groups")
    return join_spread(by_doc, of_class, "node", by_doc.count()).select("id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, seed: int = 42, least: float = 0.8) -> DataFrame:
    """One row of docs for each group of near copies, all columns, that of the smallest id: see simhash.kept_rows."""
    by_doc, classes = _roots(docs, id_col, text_col, shingle_words, seed, least)
    return kept_rows(docs, by_doc, classes, lambda t: class_of(shingles(t, shingle_words, seed)), id_col, text_col)

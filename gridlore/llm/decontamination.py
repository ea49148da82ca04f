"""Benchmark decontamination by greedy string tiling.

Texts are sequences of lower-case words. Windows of ``min_match`` words have a running Karp-Rabin hash, a seed. Seeds of documents and of the benchmark are
joined, and each document and item that share one are tiled: of the common runs of words the longest is marked as a tile (ties: first in the item, then in the
document), then the longest of what is unmarked, until none of ``min_match`` words is left. The length of the longest is found by hashing windows
of a trial length at all unmarked places of both, so words that come back a thousand times cost no more than others. Tiles may stand in any order, so reordered passages are
found too. An item is leaked by a document if its tiles cover at least ``threshold`` of its words, or if a tile has ``long_match`` words.

An item needs a number of seeds to be leaked, so that many of its most common ones, less one, aren't joined (what all items begin with joins nothing). Documents
are filtered on the way in by a bit set of the benchmark's seeds, ``BITS`` bits whatever its size: only documents with a seed, and the seeds that count, are shuffled.
Equal items are tiled once, as a class; its ids are put to the results in lists of about ``LIST``. No text is in a broadcast: a common item's text is copied to salts, a
document's text goes to each list of about ``LIST`` items or ``LIST_BYTES`` bytes of them that it is tiled with.

Defined results: null or empty texts and items without a word match nothing; items shorter than ``min_match`` match as a whole; equal items
are each reported; repeated documents are each reported; an empty benchmark or an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPREAD_KEYS, join_spread, n_seen, rows_seen, stage

_WORD = re.compile(r"\w+")
_BASE = 0x9E3779B97F4A7C15
MIN_MATCH, THRESHOLD, LONG_MATCH = 5, 0.6, 50
#: Bits of the set of seeds that goes to all tasks, as a power of two: 8 MB.
BITS = 26
#: About how many values a list in a row holds, and how many bytes of item texts.
LIST, LIST_BYTES = 256, 1 << 20
#: Hashes of words kept per worker.
CACHE_WORDS = 150_000


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_KNOWN = _Hashes()
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]  # of the base and of its inverse


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(2 * n, b, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS


class Running:
    """Karp-Rabin hashes, modulo 2^64, of windows of any length: a window's hash follows from two sums, whatever its length."""

    def __init__(self, own: list[str]):
        self.ids = np.fromiter(map(_KNOWN.__getitem__, own), np.uint64, len(own))
        self.up, down = _powers(len(own) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.ids * down[: len(own)], dtype=np.uint64)])

    def windows(self, n: int, at: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the windows of n words at places, or at all."""
        if at is None:
            at = np.arange(max(0, len(self.ids) - n + 1))
        return (self.sums[at + n] - self.sums[at]) * self.up[at]  # as if every window stood at the text's beginning


def seeds(own: Running, k: int) -> np.ndarray:
    """The hashes of all windows of k words, mixed with k."""
    h = own.windows(k) + np.uint64(k)
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def _room(free: np.ndarray) -> np.ndarray:
    """Unmarked words from each place on."""
    stop = np.where(free, len(free), np.arange(len(free)))
    return np.minimum.accumulate(stop[::-1])[::-1] - np.arange(len(free))


def tile(doc: list[str], item: list[str], min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (document position, item position, length), in the order in which they are marked."""
    both = Running(item + doc)
    n = len(item)
    ids, out = both.ids, []
    free_i, free_d, top = np.ones(n, bool), np.ones(len(doc), bool), min(n, len(doc))
    while top >= min_match:
        room_i, room_d = _room(free_i), _room(free_d)

        def at(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            q, p = np.flatnonzero(room_i >= length), np.flatnonzero(room_d >= length)
            return q, p, both.windows(length, q), both.windows(length, p + n)

        low, high = min_match - 1, min(top, int(room_i.max(initial=0)), int(room_d.max(initial=0)))
        while low < high:  # the longest common run
            mid = (low + high + 1) // 2
            q, p, hq, hp = at(mid)
            if np.isin(hq, hp, assume_unique=False).any():
                low = mid
            else:
                high = mid - 1
        if low < min_match:
            break
        q, p, hq, hp = at(low)
        hit = np.isin(hp, hq)
        p, hp = p[hit], hp[hit]
        order = np.argsort(hp, kind="stable")
        p, hp = p[order], hp[order]
        ends = dict(zip(*(x.tolist() for x in (hp[np.r_[hp[1:] != hp[:-1], True]], np.flatnonzero(np.r_[hp[1:] != hp[:-1], True])))))
        next_ = dict(zip(*(x.tolist() for x in (hp[np.r_[True, hp[1:] != hp[:-1]]], np.flatnonzero(np.r_[True, hp[1:] != hp[:-1]])))))
        for place, h in zip(q.tolist(), hq.tolist()):
            if h not in next_ or not (free_i[place] and free_i[place + low - 1]):
                continue
            k = next_[h]
            while k <= ends[h] and not (free_d[p[k]] and free_d[p[k] + low - 1]):  # marks of this round are as long as the run
                k += 1
            next_[h] = k
            if k <= ends[h] and np.array_equal(ids[place : place + low], ids[n + p[k] : n + p[k] + low]):
                out.append((int(p[k]), place, low))
                free_i[place : place + low] = False
                free_d[p[k] : p[k] + low] = False
        top = low - 1
    return out


def leak(doc: list[str], item: list[str], min_match: int = MIN_MATCH, threshold: float = THRESHOLD, long_match: int = LONG_MATCH) -> tuple[float, list[tuple[int, int, int]]] | None:
    """(share of the item's words under tiles, tiles in the document's order) if the document leaks the item."""
    if not item:
        return None
    tiles = tile(doc, item, min(min_match, len(item)))
    share = sum(t[2] for t in tiles) / len(item)
    return (share, sorted(tiles)) if share >= threshold or any(t[2] >= long_match for t in tiles) else None


def _indexed(benchmark: DataFrame, id_col: str, text_col: str, min_match: int, threshold: float, long_match: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, members, seeds): item, text of each distinct text; item, values (item_ids) in lists; hash, item, f (items that have it) of the seeds that are joined."""

    def cut(batches):
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = words(text)
                if own:
                    k = min(min_match, len(own))
                    h, c = np.unique(seeds(Running(own), k), return_counts=True)
                    needed = -(-min(max(k, int(np.ceil(threshold * len(own) - 1e-9))), max(k, long_match)) // k)
                    rows += [(i, int(x), int(n), needed, k) for x, n in zip(h.view(np.int64), c)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["item", "hash", "c", "needed", "k"])

    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    items = stage(items.withColumns({"row": F.monotonically_increasing_id(), "h": F.struct(F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b"))}), "items", **rows_seen())
    first = items.groupBy("h").agg(F.min("row").alias("item"), F.count("*").alias("f")).withColumn("n", F.col("f"))
    first = stage(first, "classes", **n_seen())  # equal texts, told by 128 bits
    classes = stage(items.join(first.select(F.col("item").alias("row")), "row").select(F.col("row").alias("item"), "text"), "texts")
    members = stage(join_spread(items.select("h", "item_id", "row"), first, "h", items.seen["rows"]), "members")
    own = stage(classes.mapInArrow(cut, "item long, hash long, c long, needed long, k long"), "item-seeds", **rows_seen())
    common = stage(own.groupBy("hash").agg(F.count("*").alias("f")).withColumn("n", F.col("f")), "item-seed-counts", **n_seen())
    order = Window.partitionBy("item").orderBy(F.col("f").desc(), "hash")  # the seeds of one item
    kept = join_spread(own, common, "hash", own.seen["rows"]).withColumn("upto", F.sum("c").over(order)).where("upto >= needed")
    return classes, _lists(members, "item", "item_id", "row"), stage(kept.select("hash", "item", "k", "f"), "seeds")


def _lists(rows: DataFrame, key: str, value: str, by: str) -> DataFrame:
    """(key, values): each key's values in lists of about LIST, dealt by the column by; f is at least the number of values that a row's key has."""
    part = F.when(F.col("f") > LIST, F.pmod(F.xxhash64(by), F.ceil(F.col("f") / LIST))).otherwise(0)
    return rows.withColumn("part", part).groupBy(key, "part").agg(F.collect_list(value).alias("values")).drop("part")


def _bits(found: DataFrame) -> np.ndarray:
    """The bit set of the seeds; its 64-bit words come from the cluster, 2^(BITS - 6) at most."""
    bit = f"shiftrightunsigned(hash, {64 - BITS})"
    word = found.selectExpr(f"shiftright({bit}, 6) as w", f"shiftleft(1L, cast({bit} & 63 as int)) as v")
    rows = word.groupBy("w").agg(F.bit_or("v").alias("v")).toPandas()
    out = np.zeros(1 << BITS - 6, np.int64)
    out[rows["w"].to_numpy(np.int64)] = rows["v"].to_numpy(np.int64)
    return out.view(np.uint64)


def _found(docs: DataFrame, benchmark: DataFrame, doc_id: str, doc_text: str, id_col: str, text_col: str, min_match: int, threshold: float, long_match: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(found, met, members): doc, item, coverage, tiles of every document and distinct item that it leaks; doc, doc_id, doc_text; item, values."""
    items, members, joined = _indexed(benchmark, id_col, text_col, min_match, threshold, long_match)
    lengths = sorted(r["k"] for r in joined.select("k").distinct().collect())  # min_match numbers at most
    bits = docs.sparkSession.sparkContext.broadcast(_bits(joined))

    def meet(batches):
        """Documents with a seed of the benchmark, and those seeds."""
        for b in batches:
            own_bits, keep, hashes = bits.value, [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                if not text:
                    continue
                own, hit = Running(words(text)), []
                for k in lengths:
                    h = seeds(own, k)
                    hit.append(h[own_bits[h >> np.uint64(70 - BITS)] >> (h >> np.uint64(64 - BITS) & np.uint64(63)) & np.uint64(1) > 0])
                if len(hit := np.unique(np.concatenate(hit)) if hit else ()):
                    keep.append(i)
                    hashes.append(hit.view(np.int64))
            if keep:
                rows = b.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(hashes, pa.list_(pa.int64()))], names=["doc_id", "doc_text", "hashes"])

    src = docs.select(F.col(doc_id).cast("long"), F.col(doc_text).cast("string"))
    met = stage(src.mapInArrow(meet, "doc_id long, doc_text string, hashes array<long>").withColumn("doc", F.monotonically_increasing_id()), "met")
    asked = met.select("doc", F.explode("hashes").alias("hash"))
    counts = asked.groupBy("hash").agg(F.count("*").alias("n"))
    of_seed = stage(_lists(joined, "hash", "item", "item").join(counts, "hash"), "asked-seeds", **n_seen())  # items that share a seed they can't do without
    pairs = stage(join_spread(asked, of_seed, "hash", of_seed.seen["total"]).select("doc", F.explode("values").alias("item")).distinct(), "pairs", **rows_seen())

    # the items' texts go to the pairs, a common item's by as many salts as it fills shares; then a document's text goes to its pairs, list by list
    per_item = pairs.groupBy("item").agg(F.count("*").alias("n"))
    both = stage(_salted(pairs, per_item, items, "item", "doc", pairs.seen["rows"]).withColumn("bytes", F.octet_length("text")), "pair-texts")
    per_doc = stage(both.groupBy("doc").agg(F.count("*").alias("n"), (1 + F.greatest(F.floor(F.count("*") / LIST), F.floor(F.sum("bytes") / LIST_BYTES))).alias("lists")), "pair-docs", **n_seen())
    listed = join_spread(both.drop("bytes"), per_doc, "doc", per_doc.seen["total"])
    listed = listed.withColumn("list", F.pmod(F.xxhash64("item"), "lists")).groupBy("doc", "list").agg(F.collect_list(F.struct("item", "text")).alias("pairs"))
    whole = met.drop("hashes", "doc_id").join(per_doc.select("doc", "lists"), "doc").select("doc", "doc_text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lists") - 1)).alias("list"))

    def tiled(batches):
        kind = pa.list_(pa.struct([("doc_start", pa.int32()), ("item_start", pa.int32()), ("length", pa.int32())]))
        for b in batches:
            rows = []
            for doc, text, own in zip(*(b.column(i) for i in range(3))):
                doc, text = doc.as_py(), words(text.as_py())
                for pair in own.as_py():
                    if found := leak(text, words(pair["text"]), min_match, threshold, long_match):
                        rows.append((doc, pair["item"], found[0], [dict(zip(("doc_start", "item_start", "length"), t)) for t in found[1]]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), kind))], names=["doc", "item", "coverage", "tiles"])

    # the hint keeps texts out of broadcasts
    out = listed.join(whole.hint("merge"), ["doc", "list"]).select("doc", "doc_text", "pairs")
    return out.mapInArrow(tiled, "doc long, item long, coverage double, tiles array<struct<doc_start: int, item_start: int, length: int>>"), met, members


def _salted(many: DataFrame, counts: DataFrame, one: DataFrame, key: str, by: str, total: int) -> DataFrame:
    """many joined with one (a row for each key) on key, shuffled. A key with more than a share of the rows goes to several tasks: its row of one is copied to as many salts, its rows of many are dealt by the column by. counts: key, n."""
    share = max(256, total // SPREAD_KEYS)
    hot = F.broadcast(counts.where(F.col("n") > share).select(key, F.ceil(F.col("n") / share).alias("salts")))  # numbers of fewer than SPREAD_KEYS keys
    salts = F.coalesce("salts", F.lit(1).cast("long"))
    many = many.join(hot, key, "left").withColumn("salt", F.pmod(F.xxhash64(by), salts)).drop("salts")
    one = one.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("salts")
    return many.join(one.hint("merge"), [key, "salt"]).drop("salt")


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", id_col: str = "item_id", text_col: str = "text", min_match: int = MIN_MATCH, threshold: float = THRESHOLD, long_match: int = LONG_MATCH) -> DataFrame:
    """(doc_id, item_id, coverage, tiles) of every document and item that it leaks."""
    found, met, members = _found(docs, benchmark, doc_id, doc_text, id_col, text_col, min_match, threshold, long_match)
    found = stage(found, "leaks")
    of_item = stage(members.join(found.groupBy("item").agg(F.count("*").alias("n")), "item"), "leaked-items")
    out = join_spread(found, of_item, "item", of_item.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    return out.join(met.select("doc", "doc_id"), "doc").select("doc_id", F.explode("values").alias("item_id"), "coverage", "tiles")


def clean(docs: DataFrame, benchmark: DataFrame, doc_text: str = "text", id_col: str = "item_id", text_col: str = "text", min_match: int = MIN_MATCH, threshold: float = THRESHOLD, long_match: int = LONG_MATCH) -> DataFrame:
    """The documents that leak no item, all columns. What a document leaks depends on its text alone, so leaking texts are told by a 128-bit hash."""
    numbered = docs.select(F.lit(0).alias("_id"), F.col(doc_text).cast("string").alias("_text"))
    found, met, _ = _found(numbered, benchmark, "_id", "_text", id_col, text_col, min_match, threshold, long_match)
    wide = "_h" + "_" * max(map(len, docs.columns))  # no column of docs
    both = lambda c: {f"{wide}1": F.xxhash64(c), f"{wide}2": F.xxhash64(c, F.lit(1))}
    bad = found.select("doc").distinct().join(met.select("doc", *[h.alias(k) for k, h in both("doc_text").items()]), "doc")
    bad = stage(bad.drop("doc").distinct(), "leaking")
    text = F.col(doc_text).cast("string")
    return docs.withColumns(both(text)).join(bad, list(both(text)), "left_anti").drop(*both(text))

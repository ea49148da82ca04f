"""SimHash near-duplicates by multi-index hashing.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's word shingles. Fingerprints are cut into
segments; of two that differ in at most ``radius`` bits, one segment differs in few bits, so every fingerprint asks the segment
tables for all values in a small Hamming ball and the full distance decides.

Defined results: a null text counts as empty; empty texts have fingerprint zero and are linked like any
other; repeated rows and repeated ids each get a row; a null id keeps its row and never names a
component unless nothing else can (then the component is null); an empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, forest
from .shared import join_spread, rows_seen, stage

#: Shingle hashes that are unpacked to bits at a time.
BITS_AT_ONCE = 1 << 16
#: Candidate pairs compared at a time.
PAIRS_AT_ONCE = 1 << 21
#: Fingerprints of a segment value beyond which its table entry is split over tasks (at least; grows so that few entries are split).
ENTRY_ROWS = 4096
#: Most segment values that may be split; the bound of the broadcast list.
SPLIT_KEYS = 50_000


def fingerprint(text: str | None, shingle_words: int = 4, seed: int = 42) -> bytes:
    """Eight bytes, most significant first. Lower-cases A-Z only; words end at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(shingle_words, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    ends = ends[k - 1 :].tolist()
    digest = xxhash.xxh64_digest
    count = np.zeros(64, np.int64)
    for at in range(0, len(starts), BITS_AT_ONCE):
        raw = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[at : at + BITS_AT_ONCE], ends[at : at + BITS_AT_ONCE])])
        count += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * count > len(starts)).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp): one row per row of docs; fp holds the unsigned fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b"".join([fingerprint(t, shingle_words, seed) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.frombuffer(raw, ">i8").astype(np.int64))], names=["id", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, fp long")


def segments(radius: int, n: int) -> list[tuple[int, int, int]]:
    """(shift, width, ball radius) of each segment: r = m*a + b, the first b+1 segments get a, the others a-1."""
    if not 0 <= radius <= 8:
        raise ValueError("radius is 0 to 8")
    m = min(radius + 1, 3 if n < 1 << 27 else 2) if radius < 6 else 4
    a, b = divmod(radius, m)
    widths = [64 // m + (i < 64 % m) for i in range(m)]
    out, shift = [], 64
    for i, w in enumerate(widths):
        shift -= w
        if (r := a if i <= b else a - 1) >= 0:
            out.append((shift, w, r))
    return out


def ball(width: int, r: int) -> list[int]:
    """Every mask of ``width`` bits with at most r set."""
    out = layer = [0]
    for _ in range(r):
        layer = sorted({m | 1 << i for m in layer for i in range(width) if not m >> i & 1})
        out = out + layer
    return out


def _links(radius: int):
    """Rows sorted by (bucket, probe): a bucket's table entries come before the probes that ask for it."""

    def pairs(entries: np.ndarray, lo: np.ndarray, n: np.ndarray, probes: np.ndarray):
        """Compare probe i with entries[lo[i] : lo[i] + n[i]], some pairs at a time."""
        probes, lo, n = probes[n > 0], lo[n > 0], n[n > 0]
        total = np.cumsum(n)
        at = 0
        while at < len(probes):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
            m = n[at:end]
            first = np.repeat(lo[at:end] - np.concatenate([[0], np.cumsum(m)[:-1]]), m)
            e, p = entries[first + np.arange(len(first))], np.repeat(probes[at:end], m)
            near = (np.bitwise_count(e ^ p) <= radius) & (e != p)
            if near.any():
                u, v = forest(e[near].view(np.int64), p[near].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_bucket, open_entries = None, np.zeros(0, np.uint64)
        for b in batches:
            bucket, probe, fp = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False).astype(bool), b.column(2).to_numpy().view(np.uint64)
            if not len(bucket):
                continue
            entries, of = fp[~probe], bucket[~probe]
            if open_bucket is not None and open_bucket == bucket[0]:
                entries, of = np.concatenate([open_entries, entries]), np.concatenate([np.full(len(open_entries), open_bucket), of])
            asked = bucket[probe]
            lo, hi = np.searchsorted(of, asked, "left"), np.searchsorted(of, asked, "right")
            yield from pairs(entries, lo, hi - lo, fp[probe])
            open_bucket = bucket[-1]
            open_entries = entries[np.searchsorted(of, open_bucket, "left") :]

    return run


def links(fps: DataFrame, radius: int = 4, n: int | None = None) -> DataFrame:
    """fps (fp), distinct -> edges (u, v) of fingerprints that connect all pairs at ``radius`` or fewer differing bits.

    A task emits a spanning forest of the links it finds, never all pairs. A segment value with very many
    fingerprints is dealt to several tasks, and those that ask for it ask each of them.
    """
    n = fps.count() if n is None else n
    segs = segments(radius, n)
    long = lambda m: F.lit(m - (1 << 64) if m >> 63 else m).cast("long")
    key = lambda i: F.shiftrightunsigned("fp", segs[i][0]).bitwiseAND(long((1 << segs[i][1]) - 1))
    tagged = lambda k, i: F.struct(F.lit(i).cast("byte").alias("seg"), k.alias("key"))
    entries = fps.select("fp", F.inline(F.array(*[tagged(key(i), i) for i in range(len(segs))])))
    probes = fps.select("fp", F.inline(F.array(*[tagged(key(i).bitwiseXOR(long(m)), i) for i, (_, w, r) in enumerate(segs) for m in ball(w, r)])))
    limit = max(ENTRY_ROWS, len(segs) * n // SPLIT_KEYS)
    hot = F.broadcast(entries.groupBy("seg", "key").agg(F.count("*").alias("c")).where(F.col("c") > limit).select("seg", "key", F.ceil(F.col("c") / limit).alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    entries = entries.join(hot, ["seg", "key"], "left").select("seg", "key", "fp", F.pmod(F.xxhash64("fp"), parts).alias("part"), F.lit(False).alias("probe"))
    probes = probes.join(hot, ["seg", "key"], "left").select("seg", "key", "fp", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.lit(True).alias("probe"))
    bucket = F.xxhash64("seg", "key", "part").alias("bucket")  # two buckets that collide only compare more
    rows = entries.unionByName(probes).select(bucket, "probe", "fp").repartition("bucket").sortWithinPartitions("bucket", "probe")
    return rows.mapInArrow(_links(radius), "u long, v long")


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, seed: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """(by_doc, classes): id and fp of each row; fp, low, n, root of each fingerprint, low the smallest id and n the number of its rows."""
    by_doc = stage(fingerprints(docs, id_col, text_col, shingle_words, seed), "fingerprints")
    fps = stage(by_doc.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n")), "classes")
    comp = connected_components(links(fps.select("fp"), radius))
    return by_doc, stage(fps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root")), "roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """(id, fp, component_id): a row for each row of docs, component_id the smallest id that links reach."""
    by_doc, classes = _classes(docs, id_col, text_col, shingle_words, seed, radius)
    low = stage(classes.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n")), "lowest")
    of_class = join_spread(classes.select("fp", F.col("n").alias("rows"), "root"), low, "root", classes.count())
    of_class = stage(of_class.select("fp", "component_id", F.col("rows").alias("n")), "groups")
    return join_spread(by_doc, of_class, "fp", by_doc.count()).select("id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """One row of docs for each group, all columns: see kept_rows."""
    by_doc, classes = _classes(docs, id_col, text_col, shingle_words, seed, radius)
    own = lambda t: int.from_bytes(fingerprint(t, shingle_words, seed), "big")
    return kept_rows(docs, by_doc.withColumnRenamed("fp", "node"), classes.withColumnRenamed("fp", "node"), own, id_col, text_col)


def kept_rows(docs: DataFrame, by_doc: DataFrame, classes: DataFrame, class_of: Callable[[str | None], int], id_col: str, text_col: str) -> DataFrame:
    """Of each group (root) the row of docs with the smallest id. by_doc (id, node), classes (node, low, root); class_of gives a text's class, unsigned.

    An id that stands for several texts names its group only with the text that is in it (of several such texts in one group the one of the smallest class number),
    and of equal rows one stays. Rows with a null id stay.
    """
    first = classes.where("low is not null").groupBy("root").agg(F.min(F.struct("low", "node")).alias("one")).select(F.col("one.low").alias("id"), F.col("one.node").alias("node"))
    first = stage(first, "first")
    times = by_doc.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id")
    unsure = stage(first.join(times, "id", "left_semi"), "unsure", **rows_seen())
    sure = docs.join(first.join(unsure.select("id").distinct(), "id", "left_anti").select(F.col("id").alias(id_col)), id_col, "left_semi")
    kept = sure.unionByName(docs.where(F.col(id_col).isNull()))
    if not unsure.seen["rows"]:
        return kept.select(docs.columns)

    @F.pandas_udf("long")
    def node(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([class_of(t) for t in texts], np.uint64).view(np.int64))

    name = "_class" + "_" * max(map(len, docs.columns))  # no column of docs
    named = docs.join(unsure.select(F.col("id").alias(id_col)).distinct(), id_col, "left_semi").withColumn(name, node(F.col(text_col).cast("string")))
    named = named.join(unsure.select(F.col("id").alias(id_col), F.col("node").alias(name)), [id_col, name], "left_semi").dropDuplicates([id_col, name])
    return kept.unionByName(named.drop(name)).select(docs.columns)

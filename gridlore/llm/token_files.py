"""Token-id files: Simple-8b words in blocks, with per-block offsets, written in ascending id order and read back.

A file holds the token ids of some documents, end ids included, one after the other:

    magic ``GLS8B001`` | blocks | index | footer

A block codes up to ``BLOCK`` ids as little-endian 64-bit words. The top four bits of a word are its selector s. s = 0 is the
escape: the next word is one id of any 64 bits. Any other selector has COUNTS[s] ids of WIDTHS[s] bits each, first id lowest; the last word
of a block may have fewer, so a block also says how many ids it has. The index holds, as little-endian arrays, each block's word
offset and id count, then each document's id and token count. The footer is three longs: blocks, documents, byte offset of the index.
A block is decoded by gathering all words of one selector at once.

The number of parts follows from the bytes of the texts, and a part that grows beyond ``FILE_TOKENS`` is written as several files, so no file
grows with the data. An id with more rows than a part holds is dealt over several. Each file is read back in a task of its own.

Defined results: a null text is empty and has the end id alone; rows with equal ids follow each other in any order; rows with a
null id come first; an empty table gives no files and no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Folder, fresh_path, stage
from .tokens import default_path, encode

MAGIC = b"GLS8B001"
#: Fixed values of the format: ids in a word and bits of each, by selector.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 1024
#: Ids that are coded or decoded at a time.
IDS_AT_ONCE = 1 << 19
#: Bytes of text that make a part, most parts (the bound of the list of their ends), and token ids beyond which a part's next document begins a new file.
PART_BYTES, MOST_PARTS, FILE_TOKENS = 32 << 20, 50_000, 1 << 26
NULL_ID = -(1 << 63)


#: Each window's length as the sum of a shorter window and a shift: the largest width in a window of n ids is found from that of m.
_FROM = {2: 1, 3: 2, 4: 2, 5: 4, 6: 4, 7: 4, 8: 4, 10: 8, 12: 8, 15: 8, 20: 12, 30: 15, 60: 30, 120: 60}
_BITS16 = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)


def _bits(ids: np.ndarray) -> np.ndarray:
    if len(ids) and ids.max() < 1 << 16:
        return _BITS16[ids.astype(np.uint16)]
    return np.searchsorted(np.array([1 << k for k in range(64)], np.uint64), ids, "right").astype(np.uint8)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids (uint64) -> (words, words of each block). All blocks advance together, one word a step."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blocks = -(-n // BLOCK)
    size = np.full(blocks, BLOCK)
    size[-1] = n - BLOCK * (blocks - 1)
    padded = np.zeros(blocks * BLOCK, np.uint8)
    padded[:n] = _bits(ids)
    top = {1: np.concatenate([padded.reshape(blocks, BLOCK), np.zeros((blocks, 120), np.uint8)], axis=1)}
    for c, m in _FROM.items():
        top[c] = top[m].copy()
        np.maximum(top[m][:, : -(c - m)], top[m][:, c - m :], out=top[c][:, : -(c - m)])
    # of the selectors whose window fits, the one with most ids; 0 where a single id is too wide
    best = np.zeros((blocks, BLOCK), np.uint8)
    for s in range(15, 0, -1):
        np.copyto(best, np.uint8(s), where=top[int(COUNTS[s])][:, :BLOCK] <= WIDTHS[s])
    del top
    at, rows = np.zeros(blocks, np.int64), np.arange(blocks)
    flat, first, starting = best.reshape(-1), np.arange(blocks) * BLOCK, np.zeros(blocks * BLOCK, bool)
    while len(rows):
        here = first[rows] + at[rows]
        starting[here] = True
        at[rows] += COUNTS[flat[here]]
        rows = rows[at[rows] < size[rows]]
    starts = np.flatnonzero(starting)
    sel, row_of = flat[starts], starts // BLOCK
    slots = 1 + (sel == 0)
    place = np.cumsum(slots) - slots
    words = np.zeros(int(slots.sum()), np.uint64)
    words[place] = sel.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(blocks * BLOCK - n + 120, np.uint64)])
    # a window never leaves its block: what lies beyond belongs to the next
    ends = first + size
    for s in np.unique(sel).tolist():
        mine = sel == s
        if s == 0:
            words[place[mine] + 1] = ids[starts[mine]]
        elif s > 1:
            a, e, word = starts[mine], ends[row_of[mine]], words[place[mine]]
            for k in range(int(COUNTS[s])):
                v = padded[a + k]
                if k:
                    v[a + k >= e] = 0
                word |= v << np.uint64(k * int(WIDTHS[s]))
            words[place[mine]] = word
    return words, np.bincount(row_of, weights=slots, minlength=blocks).astype(np.int64)


def unpack(words: np.ndarray, counts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The ids of consecutive blocks: counts ids each, words from offsets on (with the end of the last)."""
    s = (words >> np.uint64(60)).astype(np.int64)
    if (esc := np.nonzero(s == 0)[0]).size:  # raw words look like anything: walk the escapes in order
        raw, last = np.zeros(len(words), bool), -1
        for i in range(len(words)):
            if s[i] == 0 and last != i:
                raw[i + 1], last = True, i + 1
            elif last == i:
                s[i] = -1
        s[raw] = -1
    n = np.where(s >= 0, COUNTS[np.maximum(s, 0)], 0)
    # the last word of a block may be part full
    ends = np.asarray(offsets[1:]) - 1
    total = np.add.reduceat(n, offsets[:-1]) if len(counts) else np.zeros(0, np.int64)
    last = np.where(s[ends] == -1, ends - 1, ends)
    n[last] -= total - counts
    first = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.uint64)
    for k in range(16):
        if not (at := np.nonzero(s == k)[0]).size:
            continue
        if k == 0:
            out[first[at]] = words[at + 1]
            continue
        if k == 1:
            continue
        c, w = int(COUNTS[k]), int(WIDTHS[k])
        j = np.arange(c)
        v = (words[at][:, None] >> (j * w).astype(np.uint64)[None, :]) & np.uint64((1 << w) - 1)
        has = j[None, :] < n[at][:, None]
        out[(first[at][:, None] + j[None, :])[has]] = v[has]
    return out


def file_chunks(docs: Iterator[tuple[int, bytes]], told: dict) -> Iterator[bytes]:
    """The bytes of a file from (id, token ids as little-endian unsigned 32-bit bytes); told gets its documents and tokens."""
    doc_ids, lengths, offsets, counts = [], [], [0], []
    written, held, n_held = len(MAGIC), [], 0
    yield MAGIC

    def flush(whole: bool):
        nonlocal held, n_held, written
        ids = np.frombuffer(b"".join(held), "<u4")
        n = len(ids) if whole else len(ids) // BLOCK * BLOCK
        held, n_held = [ids[n:].tobytes()], len(ids) - n
        words, per = pack(ids[:n].astype(np.uint64))
        offsets.extend((offsets[-1] + np.cumsum(per)).tolist())
        counts.extend([BLOCK] * (n // BLOCK) + [n % BLOCK] * bool(n % BLOCK))
        written += 8 * len(words)
        return words.astype("<u8").tobytes()

    for i, raw in docs:
        doc_ids.append(NULL_ID if i is None else i)
        lengths.append(len(raw) // 4)
        for a in range(0, len(raw), 4 * IDS_AT_ONCE):
            held.append(raw[a : a + 4 * IDS_AT_ONCE])
            n_held += len(held[-1]) // 4
            if n_held >= IDS_AT_ONCE:
                yield flush(False)
    yield flush(True)
    for x in (offsets, counts, doc_ids, lengths):
        yield np.array(x, "<i8").tobytes()
    yield np.array([len(counts), len(doc_ids), written], "<i8").tobytes()
    told |= {"docs": len(doc_ids), "tokens": sum(lengths)}


def read_file(f) -> Iterator[tuple[int | None, np.ndarray]]:
    """(id, token ids) of each document of an open file, some blocks at a time."""
    f.seek(0, 2)
    size = f.tell()
    f.seek(0)
    if f.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token-id file")
    f.seek(size - 24)
    blocks, docs, index = np.frombuffer(f.read(24), "<i8").tolist()
    f.seek(index)
    part = lambda n: np.frombuffer(f.read(8 * n), "<i8")
    offsets, counts, doc_ids, lengths = part(blocks + 1), part(blocks), part(docs), part(docs)
    step, held, b = max(1, IDS_AT_ONCE // BLOCK), [np.zeros(0, np.uint64)], 0
    n_held = 0
    for i, n in zip(doc_ids.tolist(), lengths.tolist()):
        while n_held < n:
            e = min(blocks, b + step)
            f.seek(len(MAGIC) + 8 * int(offsets[b]))
            words = np.frombuffer(f.read(8 * int(offsets[e] - offsets[b])), "<u8")
            held.append(unpack(words, counts[b:e], offsets[b : e + 1] - offsets[b]))
            n_held += len(held[-1])
            b = e
        ids = np.concatenate(held) if len(held) > 1 else held[0]
        yield (None if i == NULL_ID else i), ids[:n]
        held, n_held = [ids[n:]], n_held - n


class Parts:
    """The part of each id. Parts ascend with the ids; an id that fills several parts is dealt over all of them."""

    def __init__(self, ends: list[int], nulls: int):
        """ends: quantiles of the ids at equal steps; nulls: parts of rows without an id."""
        self.nulls = nulls
        self.distinct, times = np.unique(np.array(ends, np.int64), return_counts=True)
        # for each distinct end a part of the ids up to it, or, if it came several times, of the ids before it and then as many parts of its own
        self.own = np.where(times > 1, times, 0)
        self.base = self.nulls + np.cumsum(1 + self.own) - (1 + self.own)
        self.n = self.nulls + 1 + len(self.distinct) + int(self.own.sum())

    def __call__(self, i: int | None, salt: int) -> int:
        if i is None:
            return salt % self.nulls if self.nulls else 0
        k = int(np.searchsorted(self.distinct, i, "left"))
        if k == len(self.distinct):
            return self.n - 1
        own = int(self.own[k])
        return int(self.base[k]) + (1 + salt % own if own and self.distinct[k] == i else 0)


def write(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int | None = 0, folder: str | None = None) -> DataFrame:
    """Write files of all documents in ascending id order -> manifest (file, part, seq, docs, tokens, bytes), staged.

    Quantiles of the ids cut the order into parts of about as many documents, and a task writes a part. File names carry the
    attempt that wrote them; only files of the manifest count, so a task that runs twice does no harm.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    tokenizer, folder = tokenizer or default_path(), folder or fresh_path(spark, "token-files")
    small = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id or 0) < 1 << 16
    kind = "<u2" if small else "<u4"
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    n, n_null, size = src.agg(F.count("*"), F.count_if(F.col("id").isNull()), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    steps = max(1, min(MOST_PARTS, -(-size // PART_BYTES)))
    ends = (src.agg(F.percentile_approx("id", [i / steps for i in range(1, steps)], 20 * steps)).first()[0] or []) if steps > 1 else []
    parts = Parts(ends, -(-n_null * steps // max(1, n)))

    def tokenise(batches):
        for b in batches:
            raw = [np.frombuffer(x + end, "<u4").astype(kind).tobytes() for x in encode(b.column(1).to_pylist(), tokenizer)]
            part = [parts(i, zlib.crc32(x)) for i, x in zip(b.column(0).to_pylist(), raw)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), b.column(0), pa.array(raw, pa.binary())], names=["part", "id", "raw"])

    def save(batches):
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        rows = (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns)))
        for part, group in groupby(rows, lambda x: x[0]):
            held, seq = next(group, None), 0
            while held is not None:

                def some():
                    nonlocal held
                    tokens = 0
                    while held is not None and tokens < FILE_TOKENS:
                        i, raw = held[1], np.frombuffer(held[2], kind).astype("<u4")
                        held = next(group, None)
                        tokens += len(raw)
                        yield i, raw.tobytes()

                name, told = f"ids-{part:06d}-{seq:05d}-{attempt}.s8b", {}
                size = Folder(folder).write(name, file_chunks(some(), told))
                yield pa.RecordBatch.from_pydict({"file": [name], "part": [part], "seq": [seq], "docs": [told["docs"]], "tokens": [told["tokens"]], "bytes": [size]})
                seq += 1

    ids = src.mapInArrow(tokenise, "part int, id long, raw binary")
    kept = ids.repartitionById(parts.n, "part").sortWithinPartitions("part", F.col("id").asc_nulls_first())
    manifest = stage(kept.mapInArrow(save, "file string, part long, seq long, docs long, tokens long, bytes long"), "manifest")
    manifest.folder = folder
    return manifest


def read(manifest: DataFrame, folder: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, from the files, a task for each; start counts the ids of all documents before it."""
    folder = folder or manifest.folder
    order = Window.orderBy("part", "seq")  # a row for each file
    starts = manifest.select("file", F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"), (F.row_number().over(order) - 1).alias("task"))

    def load(batches):
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with Folder(folder).open(name) as f:
                    out = []

                    def batch():
                        cols = list(zip(*out))
                        arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))]
                        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])

                    for i, ids in read_file(f):
                        out.append((i, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *([ids.astype(np.int64)] if with_ids else [])))
                        start += len(ids)
                        if len(out) >= (100 if with_ids else 5000):
                            yield batch()
                            out = []
                    if out:
                        yield batch()

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return starts.repartitionById(max(1, manifest.count()), "task").select("file", "start").mapInArrow(load, schema)

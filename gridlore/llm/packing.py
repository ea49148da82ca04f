"""Packing token sequences: documents are cut into pieces, pieces are packed into as few sequences as can be found.

Pieces differ only in length, so the whole table reduces to a histogram of at most ``capacity`` lengths. The driver packs the
histogram by bin completion: patterns of lengths, each used many times. Pieces then take their places from their
rank among those of equal length. What the driver holds is bounded by the capacity, whatever the input.

Bin completion: best-fit decreasing gives the incumbent. A depth-first search fills a sequence around the largest length left with each undominated
choice of smaller ones, best sums first, from as often as the counts allow down to once, and goes
back where the waste so far exceeds what a solution better than the incumbent may waste. The same search then runs on small windows of the incumbent: the
emptiest sequence and a few others are filled anew so that the others waste less, until the emptiest is empty. A packing problem can't be
searched to its end at this size, so both searches end at the lower bound, which is the proof, or after a number of steps;
the incumbent is always a whole packing, and ``complete`` returns the bound with it, so the gap is known.

Defined results: a null text is empty and has the end id alone; repeated rows are packed like any other; null ids keep their rows;
an empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage
from .tokens import default_path, encode

CAPACITY = 1024
#: A filling: (length, how many) pairs, longest first.
Pattern = tuple[tuple[int, int], ...]


def spans(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter."""
    if n <= capacity:
        yield 0, n
        return
    start = n % capacity
    if start:
        yield 0, start
    while start < n:
        yield start, capacity
        start += capacity


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The better of the total and, for each k, lengths over capacity - k alone, those over half alone, and what fits beside them."""
    total = sum(s * n for s, n in counts.items())
    best = -(-total // capacity)
    n_of, sum_of = np.zeros(capacity + 2, np.int64), np.zeros(capacity + 2, np.int64)
    for s, n in counts.items():
        n_of[s], sum_of[s] = n, n * s
    n_to, sum_to = np.cumsum(n_of), np.cumsum(sum_of)
    half = capacity // 2
    for k in range(half + 1):
        big = n_to[capacity] - n_to[half]
        mid_sum = sum_to[capacity - k] - sum_to[half]
        mid_n = n_to[capacity - k] - n_to[half]
        small = sum_to[half] - (sum_to[k - 1] if k else 0)
        best = max(best, int(big + max(0, -(-(small - (mid_n * capacity - mid_sum)) // capacity))))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over a histogram: sequences that look alike are handled together."""
    rest: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)
    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            r = next((r for r in range(s, capacity) if rest.get(r)), None)
            have, k = rest[r].pop() if r is not None else ((), n)
            room = capacity if r is None else r
            m = min(room // s, n)
            used = min(k, n // m)
            if r is not None and used < k:
                rest[r].append((have, k - used))
            rest[room - m * s].append((have + ((s, m),), used))
            n -= used * m
    return [x for group in rest.values() for x in group]


def _reach(sizes: list[int], left: dict[int, int], room: int) -> list[int]:
    """Bit sets of the sums up to room that the first i sizes (ascending) can make."""
    mask, out = (1 << room + 1) - 1, [1]
    for s in sizes:
        bits, n, p = out[-1], min(left[s], room // s), 1
        while n > 0:
            take = min(p, n)
            bits |= bits << take * s & mask
            n -= take
            p *= 2
        out.append(bits)
    return out


def fillings(left: dict[int, int], capacity: int, slack: int) -> Iterator[tuple[Pattern, int]]:
    """(pattern, waste) around the largest length for all undominated fillings that waste at most slack; best sums first, of equal sums the largest lengths first.

    A filling is dominated if one length left over could stand for one or two of its lengths: what they leave packs wherever it would have gone.
    """
    top = max(left)
    room = capacity - top
    rest = dict(left)
    rest[top] -= 1
    sizes = sorted(s for s, n in rest.items() if n and s <= room)
    reach = _reach(sizes, rest, room)
    there = sum(1 << s for s in sizes)

    def of(sum_: int, i: int) -> Iterator[Pattern]:
        if not sum_:
            yield ()
            return
        for j in range(i, 0, -1):
            s = sizes[j - 1]
            if s > sum_:
                continue
            if not reach[j] >> sum_ & 1:
                return
            for m in range(min(rest[s], sum_ // s), 0, -1):
                if reach[j - 1] >> sum_ - m * s & 1:
                    for more in of(sum_ - m * s, j - 1):
                        yield ((s, m), *more)

    def dominated(p: Pattern, waste: int) -> bool:
        free = there
        for s, m in p:
            if rest[s] == m:
                free &= ~(1 << s)
        one = [s for s, m in p for _ in range(min(m, 2))]
        window = (1 << waste + 1) - 1
        return any(free >> y + 1 & window >> 1 for y in {*one}) or any(free >> y & window for y in {x + y for k, x in enumerate(one) for y in one[k + 1 :]})

    for t in range(room, max(0, room - slack) - 1, -1):
        if reach[-1] >> t & 1:
            for p in of(t, len(sizes)):
                if not dominated(p, room - t):
                    yield (((top, 1 + p[0][1]), *p[1:]) if p and p[0][0] == top else ((top, 1), *p)), room - t


def _search(counts: dict[int, int], capacity: int, allowed: int, nodes: int, bins: int | None = None) -> list[tuple[Pattern, int]] | None:
    """A packing that wastes at most allowed; or, with bins, so many sequences and what is left as one more (whose waste doesn't count). None: there is none, or not found in so many steps."""
    left, chosen, waste, used = dict(counts), [], 0, 0

    def often() -> Iterator[tuple[Pattern, int, int]]:
        for p, w in fillings(left, capacity, allowed - waste):
            most = min(left[s] // m for s, m in p)
            if w:
                most = min(most, (allowed - waste) // w)
            for k in range(most if bins is None else min(most, bins - used), 0, -1):
                yield p, k, w

    def back() -> None:
        nonlocal waste, used
        p, k, w = chosen.pop()
        waste, used = waste - k * w, used - k
        for s, m in p:
            left[s] = left.get(s, 0) + m * k

    stack = [often()]
    for _ in range(nodes):
        if not stack:
            return None
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if chosen:
                back()
            continue
        p, k, w = step
        for s, m in p:
            left[s] -= m * k
            if not left[s]:
                del left[s]
        chosen.append(step)
        waste, used = waste + k * w, used + k
        if not left or used == bins:
            if sum(s * n for s, n in left.items()) <= capacity:
                return [(p, k) for p, k, _ in chosen] + ([(tuple(sorted(left.items(), reverse=True)), 1)] if left else [])
            back()
        else:
            stack.append(often())
    return None


def complete(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = 5000, windows: int = 6000, seed: int = 1) -> tuple[list[tuple[Pattern, int]], int]:
    """(patterns with how often each is used, lower bound)."""
    counts = {int(s): int(n) for s, n in counts.items() if n}
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("lengths are 1 to capacity")
    total, bound = sum(s * n for s, n in counts.items()), lower_bound(counts, capacity)
    best = Counter()
    for p, k in best_fit(counts, capacity):
        best[p] += k
    while sum(best.values()) > bound and (found := _search(counts, capacity, (sum(best.values()) - 1) * capacity - total, nodes)):
        best = Counter()
        for p, k in found:
            best[p] += k
    wastes = lambda p: capacity - sum(s * m for s, m in p)
    rng, waste = random.Random(seed), {p: wastes(p) for p in best}
    loose, full = [p for p in waste if waste[p]], [p for p in waste if not waste[p] and len(p) > 1]
    for _ in range(windows):
        if sum(best.values()) == bound or not loose:
            break
        emptiest = max(loose, key=waste.__getitem__)
        others = [p for p in rng.sample(loose, min(len(loose), rng.randint(2, 7))) if p != emptiest]
        others += rng.sample(full, min(len(full), rng.choice((0, 0, 1, 2))))
        window = Counter()
        for p in (emptiest, *others):
            window.update(dict(p))
        found = _search(window, capacity, sum(waste[p] for p in others) - 1, 60, len(others)) if others else None
        if found is None:
            continue
        best.subtract([emptiest, *others])
        for p, k in found:
            best[p] += k
        best = +best
        waste = {p: waste[p] if p in waste else wastes(p) for p in best}
        loose, full = [p for p in waste if waste[p]], [p for p in waste if not waste[p] and len(p) > 1]
    return list(best.items()), bound


def _runs(patterns: list[tuple[Pattern, int]]) -> np.ndarray:
    """Rows (length, first rank, ranks, first sequence, offset, how many in a sequence), by length and rank."""
    rank, seq, out = defaultdict(int), 0, []
    for p, k in patterns:
        offset = 0
        for s, m in p:
            out.append((s, rank[s], k * m, seq, offset, m))
            rank[s] += k * m
            offset += s * m
        seq += k
    return np.array(sorted(out), np.int64).reshape(-1, 6)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, chunk[, ids]); chunk is the task that made the row."""
    tokenizer = tokenizer or default_path()

    def run(batches):
        from pyspark import TaskContext

        chunk, end = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows = []
            for i, raw in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist(), tokenizer)):
                raw += end
                for k, (start, n) in enumerate(spans(len(raw) // 4, capacity)):
                    part = raw[4 * start : 4 * (start + n)]
                    rows.append((i, k, start, n, zlib.crc32(part), chunk, *([np.frombuffer(part, "<u4").astype(np.int32)] if keep_ids else [])))
            if rows:
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "ids"][: len(rows[0])])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk long" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]."""
    rows = stage(pieces(docs, id_col, text_col, tokenizer, end_id, capacity, keep_ids), "pieces")
    counts = stage(rows.groupBy("chunk", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    runs = _runs(complete(histogram, capacity)[0])
    span = 1 + int(max(histogram.values(), default=0))
    starts = runs[:, 0] * span + runs[:, 1]

    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("chunk")) - F.col("n")).drop("n")
    order = Window.partitionBy("chunk", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(order) - 1).join(before, ["chunk", "length"]).withColumn("rank", F.col("rank") + F.col("before"))

    def place(batches):
        for b in batches:
            length, rank = b.column(0).to_numpy(), b.column(1).to_numpy()
            r = runs[np.searchsorted(starts, length * span + rank, "right") - 1]
            q = rank - r[:, 1]
            cols = {f.name: c for f, c in zip(b.schema, b.columns)}
            del cols["rank"]
            yield pa.RecordBatch.from_pydict(cols | {"sequence_id": r[:, 3] + q // r[:, 5], "offset": r[:, 4] + q % r[:, 5] * length})

    schema = "length long, doc_id long, piece int, start long, ids_crc32 long" + ", ids array<int>" * keep_ids + ", sequence_id long, offset long"
    out = ranked.select("length", "rank", "doc_id", "piece", "start", "ids_crc32", *["ids"] * keep_ids).mapInArrow(place, schema)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * keep_ids)

"""Prefix trie of conversations by partition refinement.

All conversations start in one class, the root. A turn splits each active class by what is said in it; a class is a node of the trie, named by its depth and its
smallest conversation. A class of one conversation is retired: its remaining turns are a chain of nodes without branches, emitted row by row. A class of few turns (CLASS_ROWS, a bound of
memory) is refined to its end inside one task, many classes at a time in numpy, by the same rule. So Spark makes a round only for each depth to which a large class reaches.
Then the levels are folded back, deepest first: children, leaves and saved tokens of a node are sums over its children.

Conversations with the same turns, however many, are one member with a weight: 192 bits of exclusive-or over the hashes of place and turn tell them, without an order
and combined before the shuffle. A turn is told by the SHA-256 of role and text; texts are read once and aren't shuffled.

Places in a conversation come from a sort by ranges with counts carried from range to range, so a conversation of very many turns is in no single task either. Ids of the
conversations that end at a node are joined to short texts by range, in order; only the digest itself, which can't be divided, reads a node's texts in one task, as a stream.

Defined results: turns without conv_id belong to no conversation; a null role or text is empty; turns go by number, null first, those of one number by role and then by SHA-256 of
role and text, each counting (a repeated row is a turn of its own); a conversation without turns is a member of the root alone; an empty table gives no rows, not even a root; other
columns, whatever their names, don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .audit import SPACE
from .shared import join_spread, stage, unstage

#: A class with at most so many turns left is refined inside a task.
CLASS_ROWS = 20_000
#: Ids in one text for the digests.
IDS_AT_ONCE = 400
NODE = "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends long, top boolean"
_COLUMNS = [c.split()[0] for c in NODE.split(", ")]


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place and words before, within this task's stretch of each conversation; rows come in order."""
    part, last, n, before = TaskContext.get().partitionId(), None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        conv, words = b.column("conv_id").to_numpy(), b.column("words").to_numpy().astype(np.int64)
        new = np.flatnonzero(np.r_[conv[0] != last, conv[1:] != conv[:-1]])
        run = np.searchsorted(new, np.arange(len(conv)), "right") - 1  # -1: goes on with the run of the batch before
        first, sums = np.where(run < 0, 0, new[run] if len(new) else 0), np.r_[0, np.cumsum(words)]
        pos = np.arange(len(conv)) - first + np.where(run < 0, n, 0)
        at = sums[:-1] - sums[first] + np.where(run < 0, before, 0)
        last, n, before = conv[-1], int(pos[-1]) + 1, int(at[-1] + words[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), part, np.int64)), b.column("conv_id"), pa.array(pos.astype(np.int64)), b.column("tok"), b.column("words"), pa.array(at)], ["part", "conv_id", "pos", "tok", "words", "before"])


def ordered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos from 0, tok, words, before: words of the turns before) and the ids of all conversations."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    tok = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), tok.alias("tok"), F.size(F.array_remove(F.split(text, SPACE), "")).cast("long").alias("words"))
    slim = stage(rows, "turns")
    key = ("conv_id", F.col("turn").asc_nulls_first(), "role", "tok")
    stretches = slim.repartitionByRange(*key).sortWithinPartitions(*key).select("conv_id", "tok", "words").mapInArrow(_numbered, "part long, conv_id long, pos long, tok binary, words long, before long")
    stretches = stage(stretches, "stretches")
    ids = stage(stretches.groupBy("conv_id").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("n")), "ids")
    unstage(slim)
    cut = F.broadcast(ids.where("lo < hi").select("conv_id"))  # a boundary of ranges cuts one conversation: fewer than there are ranges
    if not ids.where("lo < hi").isEmpty():
        so_far = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        pieces = stretches.join(cut, "conv_id").groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
        offsets = pieces.select("conv_id", "part", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("n0"), F.coalesce(F.sum("w").over(so_far), F.lit(0)).alias("w0"))
        stretches = stretches.join(F.broadcast(stage(offsets, "offsets")), ["conv_id", "part"], "left").withColumns({"pos": F.col("pos") + F.coalesce("n0", F.lit(0)), "before": F.col("before") + F.coalesce("w0", F.lit(0))})
    return stretches.select("conv_id", "pos", "tok", "words", "before"), ids.select("conv_id", "n")


def grafted(turns: DataFrame, ids: DataFrame, head_of: Column, n_head: Column, most: int) -> DataFrame:
    """Each conversation's turns from n_head on, behind the first n_head (at most ``most``) turns of conversation head_of; both are expressions of conv_id.

    turns and ids are those of ``ordered``. ``own`` tells the turns that stay from those put before them. No conversation may be the head of unboundedly many others.
    """
    takers = ids.select(F.col("conv_id").alias("taker"), "n", head_of.alias("conv_id"), n_head.alias("h")).where("h > 0")
    takers = takers.join(ids.withColumnRenamed("n", "head_n"), "conv_id", "left").withColumn("short", F.col("h") - F.least("h", F.coalesce("head_n", F.lit(0))))
    takers = stage(takers, "takers")
    heads = turns.where(F.col("pos") < most).join(takers, "conv_id").where("pos < h").select(F.col("taker").alias("conv_id"), "pos", "tok", "words", "before", F.lit(False).alias("own"))
    # behind a head of fewer turns the others move up
    up = takers.where("short > 0 and n > h").select(F.col("taker").alias("conv_id"), "short")
    own = turns.where(F.col("pos") >= n_head).join(up, "conv_id", "left").select("conv_id", (F.col("pos") - F.coalesce("short", F.lit(0))).alias("pos"), "tok", "words", "before", F.lit(True).alias("own"))
    return own.unionByName(heads)


def _groups(turns: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations of the same turns: (sums of each conversation with ``same``, a row for each group: rep, weight, len, total, own_end)."""
    print_of = [F.bit_xor(F.xxhash64(F.lit(k), "pos", "tok")).alias(f"x{k}") for k in range(3)]
    sums = turns.groupBy("conv_id").agg(F.count("*").alias("len"), F.sum("words").alias("total"), F.max(F.when(F.col("own"), F.col("before") + F.col("words"))).alias("own_end"), *print_of)
    sums = ids.select("conv_id").join(sums, "conv_id", "left").fillna(0)
    sums = stage(sums.select("conv_id", "len", "total", "own_end", F.struct("len", "x0", "x1", "x2").alias("same")), "sums")
    first = lambda c: F.min_by(c, "conv_id").alias(c)
    groups = sums.groupBy("same").agg(F.min("conv_id").alias("rep"), F.count("*").alias("weight"), first("len"), first("total"), first("own_end"))
    return sums, stage(groups, "groups")


def _ids_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of rep and conv_id to texts of IDS_AT_ONCE ids."""
    for b in batches:
        rep, conv = b.column("rep").to_numpy(), b.column("conv_id").to_numpy()
        cuts = np.flatnonzero(np.r_[True, rep[1:] != rep[:-1]]) if len(rep) else np.array([], int)
        spans = [(i, min(i + IDS_AT_ONCE, hi)) for lo, hi in zip(cuts, [*cuts[1:], len(rep)]) for i in range(lo, hi, IDS_AT_ONCE)]
        yield pa.RecordBatch.from_arrays([pa.array([rep[i] for i, _ in spans], pa.int64()), pa.array([conv[i] for i, _ in spans], pa.int64()), pa.array([",".join(map(str, conv[i:j].tolist())) for i, j in spans], pa.string())], ["rep", "at", "ids"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in order of rep and place to a SHA-256 for each rep."""
    now, sha = None, None
    reps, hexes = [], []

    def done():
        if sha is not None:
            reps.append(now)
            hexes.append(sha.hexdigest())

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(hexes, pa.string())], ["ends", "ends_sha256"])
        reps.clear()
        hexes.clear()
        return out

    for b in batches:
        for rep, ids in zip(b.column("rep").to_pylist(), b.column("ids").to_pylist()):
            if sha is None or rep != now:
                done()
                now, sha = rep, hashlib.sha256(ids.encode())
            else:
                sha.update(f",{ids}".encode())
        yield flush()
    done()
    yield flush()


def _digests(sums: DataFrame, groups: DataFrame) -> DataFrame:
    """(ends, ends_sha256) of groups with more than one conversation."""
    several = groups.where("weight > 1").select("same", "rep", F.col("weight").alias("n"))
    total = several.agg(F.sum("n")).first()[0]
    if not total:
        return sums.sparkSession.createDataFrame([], "ends long, ends_sha256 string")
    members = stage(join_spread(sums.select("conv_id", "same"), several, "same", total).select("rep", "conv_id"), "members")
    texts = stage(members.repartitionByRange("rep", "conv_id").sortWithinPartitions("rep", "conv_id").mapInArrow(_ids_joined, "rep long, at long, ids string"), "texts")
    return texts.repartition("rep").sortWithinPartitions("rep", "at").mapInArrow(_digested, "ends long, ends_sha256 string")


def _refined(rows: pd.DataFrame) -> pd.DataFrame:
    """All nodes below the classes in ``rows`` (whole classes: depth, cls, rep, pos, tok, words, suffix, weight, len), and a row of sums (top) for each class."""
    rows = rows.sort_values(["depth", "cls", "rep", "pos"], kind="stable")
    depth, cls, rep, words, suffix, weight = (rows[c].to_numpy(np.int64) for c in ("depth", "cls", "rep", "words", "suffix", "weight"))
    tok = pd.factorize(rows["tok"])[0].astype(np.int64)
    start = np.flatnonzero(np.r_[True, (rep[1:] != rep[:-1]) | (cls[1:] != cls[:-1]) | (depth[1:] != depth[:-1])])
    left = np.diff(np.r_[start, len(rep)])
    group = np.r_[True, (cls[start][1:] != cls[start][:-1]) | (depth[start][1:] != depth[start][:-1])]
    at = np.cumsum(group) - 1
    top = {"depth": depth[start][group], "conv_id": cls[start][group]}
    kinds, levels, chains = int(tok.max()) + 1, [], []
    live, name = np.arange(len(start)), top["conv_id"][at]
    j = 0
    while len(live):
        r = start[live] + j
        uniq, to = np.unique(at * kinds + tok[r], return_inverse=True)
        k = np.bincount(to, minlength=len(uniq))
        least, n, ends = np.full(len(uniq), np.iinfo(np.int64).max), np.zeros(len(uniq), np.int64), np.full(len(uniq), -1, np.int64)
        np.minimum.at(least, to, rep[r])
        np.add.at(n, to, weight[r])
        over = left[live] == j + 1
        ends[to[over]] = live[over]  # one at most: members differ
        some = np.zeros(len(uniq), np.int64)
        some[to] = np.arange(len(live))
        s = live[some]
        level = {"depth": depth[start[s]] + j + 1, "conv_id": least, "parent_conv_id": name[some], "n_convs": n, "own": (n - 1) * words[start[s] + j], "ends": ends, "parent": at[some], "n_children": np.zeros(len(uniq), np.int64), "n_leaves": np.zeros(len(uniq), np.int64), "below": np.zeros(len(uniq), np.int64)}
        single = k == 1
        e = s[single]  # their tails are chains
        more = left[e] > j + 1
        level["n_children"][single], level["n_leaves"][single] = more, more
        nxt = np.minimum(start[e] + j + 1, len(rep) - 1)
        level["below"][single] = np.where(more, (weight[start[e]] - 1) * suffix[nxt], 0)
        chains += [np.arange(start[x] + j + 1, start[x] + left[x]) for x in e[more]]
        levels.append(level)
        go = ~single[to] & ~over
        live, at, name = live[go], to[go], least[to[go]]
        j += 1

    def add(level, to):
        np.add.at(to["n_children"], level["parent"], 1)
        np.add.at(to["n_leaves"], level["parent"], np.where(level["n_children"] == 0, 1, level["n_leaves"]))
        np.add.at(to["below"], level["parent"], level["own"] + level["below"])

    top |= {c: np.zeros(len(top["depth"]), np.int64) for c in ("n_children", "n_leaves", "below")}
    for i in range(len(levels) - 1, -1, -1):
        add(levels[i], levels[i - 1] if i else top)
    out = []
    for level in levels:
        ends = pd.array(np.where(level["ends"] >= 0, rep[start[np.maximum(level["ends"], 0)]], 0), "Int64")
        ends[level["ends"] < 0] = pd.NA
        out.append(pd.DataFrame({c: level[c] for c in _COLUMNS[:5]} | {"n_leaves": np.where(level["n_children"] == 0, 1, level["n_leaves"]), "saved_tokens": level["own"] + level["below"], "ends": ends, "top": False}))
    if chains:
        c = np.concatenate(chains)
        pos, length = rows["pos"].to_numpy(np.int64)[c], rows["len"].to_numpy(np.int64)[c]
        ends = pd.array(rep[c], "Int64")
        ends[pos + 1 < length] = pd.NA
        out.append(pd.DataFrame({"depth": pos + 1, "conv_id": rep[c], "parent_conv_id": rep[c], "n_convs": weight[c], "n_children": (pos + 1 < length).astype(np.int64), "n_leaves": 1, "saved_tokens": (weight[c] - 1) * suffix[c], "ends": ends, "top": False}))
    out.append(pd.DataFrame({"depth": top["depth"], "conv_id": top["conv_id"], "parent_conv_id": pd.NA, "n_convs": 0, "n_children": top["n_children"], "n_leaves": top["n_leaves"], "saved_tokens": top["below"], "ends": pd.NA, "top": True}))
    return pd.concat([x.astype({"parent_conv_id": "Int64", "ends": "Int64"}) for x in out])[_COLUMNS]


def _small_classes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Refine whole classes, many at a time; rows come in order of the classes."""
    held = None
    for f in frames:
        held = f if held is None else pd.concat([held, f])
        last = held[["depth", "cls"]].iloc[-1] if len(held) else None
        if len(held) > CLASS_ROWS:
            goes_on = (held["depth"] == last["depth"]) & (held["cls"] == last["cls"])
            if not goes_on.all():
                yield _refined(held[~goes_on])
                held = held[goes_on]
    if held is not None and len(held):
        yield _refined(held)


def trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for each node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    turns: (conv_id, pos, tok, words, before, own) as of ``grafted`` (own: all true for plain conversations); ids: every conversation, with turns or without.
    """
    turns = stage(turns, "turns")
    sums, groups = _groups(turns, ids)
    root = groups.agg(F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum("len").alias("rows"), F.max(F.when(F.col("len") == 0, F.col("rep"))).alias("ends"), F.count("*").alias("k")).first()
    if not root.k:
        return sums.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    reps = groups.select(F.col("rep").alias("conv_id"), "weight", "len", "total", "own_end", F.col("len").alias("n"))
    to_end = F.when(F.col("own"), F.col("own_end")).otherwise(F.col("total")) - F.col("before")  # words from this turn on
    mine = join_spread(turns, reps, "conv_id", max(1, root.rows)).select(F.col("conv_id").alias("rep"), "pos", "tok", "words", to_end.alias("suffix"), "weight", "len")
    mine = stage(mine.sortWithinPartitions("pos"), "mine")  # a round reads the pages of one place
    unstage(turns)

    spark = sums.sparkSession
    levels = [spark.createDataFrame([(0, root.conv_id, None, root.n_convs, 0, root.ends)], "depth long, conv_id long, parent_conv_id long, n_convs long, words long, ends long")]
    alone = (F.col("k") == 1).alias("alone")
    seed = groups.where("len > 0").select("rep", "len", F.lit(0).cast("long").alias("depth"), F.lit(root.conv_id).cast("long").alias("cls"), F.lit(root.k).cast("long").alias("k"), F.lit(root.rows).cast("long").alias("rows"))
    large = f"k > 1 and rows > {CLASS_ROWS}"
    retired, active, any_large = [seed.where(f"not ({large})").select("rep", "len", "depth", "cls", alone)], seed.where(large), root.k > 1 and root.rows > CLASS_ROWS
    d = 0
    while any_large:
        here = stage(active.select("rep", "cls").join(mine.where(F.col("pos") == d), "rep"), "here")
        split = here.groupBy("cls", "tok").agg(F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max("words").alias("words"), F.count("*").alias("k"), F.sum(F.col("len") - d - 1).alias("rows"), F.max(F.when(F.col("len") == d + 1, F.col("rep"))).alias("ends"))
        split = stage(split, "split")
        about = split.agg(F.sum("k"), F.max(F.expr(f"{large}"))).first()
        levels.append(split.select(F.lit(d + 1).cast("long").alias("depth"), "conv_id", F.col("cls").alias("parent_conv_id"), "n_convs", "words", "ends"))
        to = join_spread(here.where(F.col("len") > d + 1).select("rep", "len", "cls", "tok"), split.select("cls", "tok", "conv_id", "k", "rows", F.col("k").alias("n")), ["cls", "tok"], about[0])
        to = stage(to.select("rep", "len", F.lit(d + 1).cast("long").alias("depth"), F.col("conv_id").alias("cls"), "k", "rows"), "to")
        retired.append(to.where(f"not ({large})").select("rep", "len", "depth", "cls", alone))
        active, any_large = to.where(large), about[1]
        unstage(here)
        d += 1

    gone = retired[0]
    for x in retired[1:]:
        gone = gone.unionByName(x)
    tails = join_spread(mine, stage(gone.withColumn("n", F.col("len")).drop("len"), "gone"), "rep", max(1, root.rows)).where("pos >= depth")
    tails = stage(tails, "tails")
    small = tails.where("not alone").drop("alone").repartition("depth", "cls").sortWithinPartitions("depth", "cls").mapInPandas(_small_classes, NODE)
    chain = tails.where("alone").select((F.col("pos") + 1).alias("depth"), F.col("rep").alias("conv_id"), F.col("rep").alias("parent_conv_id"), F.col("weight").alias("n_convs"), F.when(F.expr("pos + 1 < len"), 1).otherwise(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.expr("(weight - 1) * suffix").alias("saved_tokens"), F.when(F.expr("pos + 1 = len"), F.col("rep")).alias("ends"), F.lit(False).alias("top"))
    tops = tails.where("alone and pos = depth").select("depth", F.col("cls").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(0).cast("long").alias("n_convs"), F.lit(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.expr("(weight - 1) * suffix").alias("saved_tokens"), F.lit(None).cast("long").alias("ends"), F.lit(True).alias("top"))
    below = stage(small.unionByName(chain).unionByName(tops), "below")
    unstage(tails)

    nodes = below.where("not top").drop("top")
    folded = None
    for d in range(len(levels) - 1, -1, -1):
        sums_below = below.where(F.col("top") & (F.col("depth") == d)).select("conv_id", "n_children", "n_leaves", "saved_tokens")
        if folded is not None:
            sums_below = sums_below.unionByName(folded.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))
        folded = levels[d].join(sums_below, "conv_id", "left").select("depth", "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), (F.expr("(n_convs - 1) * words") + F.coalesce("saved_tokens", F.lit(0))).alias("saved_tokens"), "ends")
        folded = stage(folded, "folded")
        nodes = nodes.unionByName(folded)
    ended = nodes.where("ends is not null").join(_digests(sums, groups), "ends", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.col("ends").cast("string"), 256)))
    others = nodes.where("ends is null").withColumn("ends_sha256", F.sha2(F.lit(""), 256))
    return ended.unionByName(others).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def of_conversations(conversations: DataFrame) -> DataFrame:
    """The trie of plain conversations (conv_id, turn, role, text)."""
    turns, ids = ordered(conversations)
    return trie(turns.withColumn("own", F.lit(True)), ids)

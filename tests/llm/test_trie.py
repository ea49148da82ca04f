"""The prefix trie against plain sets of prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridlore.llm import queries_more, shared, trie

ROWS = "conv_id long, turn long, role string, text string, tok int, ends string"


def in_order(rows):
    turns = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[c].append(((t is not None, t), role, sha, text))
    return {c: [(role, text) for _, role, _, text in sorted(v, key=lambda x: (x[0][0], x[0][1] or 0, *x[1:]))] for c, v in turns.items()}


def rebuilt(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        head = c - (abs(c) % 20) * (1 if c > 0 else -1)
        out[c] = turns.get(head, [])[:h] + own[h:]
    return out


def plain(turns):
    nodes = defaultdict(list)
    for c, ts in turns.items():
        for d in range(len(ts) + 1):
            nodes[tuple(ts[:d])].append(c)
    words = lambda s: len(re.findall(r"[^\x20\x09-\x0D]+", s))
    children, out = defaultdict(int), {}
    leaves, saved = defaultdict(int), defaultdict(int)
    for path in nodes:
        if path:
            children[path[:-1]] += 1
    for path, of in nodes.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(of) - 1) * words(path[-1][1]) if path else 0
    for path, of in nodes.items():
        ends = ",".join(str(c) for c in sorted(of) if len(turns[c]) == len(path))
        parent = min(nodes[path[:-1]]) if path else None
        out[min(of), len(path)] = (parent, len(of), children[path] if path in children else 0, leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest())
    return out


def rows_of(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def conversations(seed, n, length=6, said=3):
    r = random.Random(seed)
    rows = []
    for c in range(-n // 4, n):
        for t in range(r.randrange(1, length)):
            rows.append((c, r.choice([t, t, None]) if t == 0 else t, r.choice(["user", "bot", None]) if c % 7 == 0 else "user", r.choice(["a", "b c", "", None, "d\te  f"][:said]), t, "x"))
    return rows


@pytest.mark.parametrize("most", [12, 20_000])
def test_equals_plain_sets_of_prefixes(spark, monkeypatch, most):
    monkeypatch.setattr(trie, "CLASS_ROWS", most)
    rows = conversations(2, 70) + [(None, 0, "user", "no conversation", 0, "")] * 3 + [(5, 2, "user", "a", 0, "")] * 2
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    if most > 12:
        assert rows_of(trie.of_conversations(df)) == plain(in_order(rows))
    assert rows_of(queries_more.rebuilt_trie(df)) == plain(rebuilt(in_order(rows)))


def test_copies_a_hot_turn_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "CLASS_ROWS", 250)  # the long ones are one class below that
    monkeypatch.setattr(trie, "IDS_AT_ONCE", 7)
    monkeypatch.setattr(shared, "SPREAD_KEYS", 2)
    rows = [(c, t, "user", f"w{t} " * t, 0, "") for c in range(100, 400) for t in range(3)]  # one group of copies
    rows += [(c, t, "user", "w0" if t == 0 else f"{c} {t}", 0, "") for c in range(400, 440) for t in range(4)]
    rows += [(c, t, "user", f"long {t}", 0, "") for c in (1, 2, 900, 901) for t in range(60 + c // 900)] + [(901, 600, "user", "other", 0, "")]
    got, want = rows_of(trie.of_conversations(spark.createDataFrame(rows, ROWS).repartition(5))), plain(in_order(rows))
    assert got == want


def test_a_conversation_over_several_ranges(spark):
    """Places and sums go on from one task to the next."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(7, t, "user", "w " * (t % 5), 0, "") for t in range(150)] + [(c, t, "bot", "x y", 0, "") for c in (3, 9) for t in range(20)]
        turns, ids = trie.ordered(spark.createDataFrame(rows, ROWS))
        seven = [r for r in turns.where("conv_id = 7").orderBy("pos").collect()]
        assert ids.count() == 3 and [r.pos for r in seven] == list(range(150)) and [r.before for r in seven] == [sum(i % 5 for i in range(t % 5)) + t // 5 * 10 for t in range(150)]
        assert rows_of(trie.of_conversations(spark.createDataFrame(rows, ROWS))) == plain(in_order(rows))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_defined_cases(spark):
    empty = spark.createDataFrame([], ROWS)
    assert rows_of(trie.of_conversations(empty)) == {} and rows_of(queries_more.rebuilt_trie(empty)) == {}
    one = [(41, 0, "user", "only own", 0, "")]  # its head, 40, is absent; crc32("41") % 4 > 0 leaves no turn
    for rows in (one, [(c, 0, None, None, 0, "") for c in range(21, 39)] + [(3, None, "u", "", 0, ""), (3, 1, "u", "x" * 2_000_000 + " y", 0, "")]):
        assert rows_of(queries_more.rebuilt_trie(spark.createDataFrame(rows, ROWS))) == plain(rebuilt(in_order(rows)))
    clash = spark.createDataFrame([(1, 0, "u", "a", 9, "b", 5)], ROWS + ", pos long").withColumn("rep", F.lit("z"))
    assert rows_of(trie.of_conversations(clash)) == plain({1: [("u", "a")]})

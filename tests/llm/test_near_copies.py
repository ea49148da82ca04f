"""The pipeline's near copies against brute force on whole shingle sets."""

import random

import numpy as np
import pytest

from gridlore.llm import near_copies


def plain_set(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_copies_from_similarity_08(spark):
    import corpus_pipeline as cp

    r, rows = random.Random(3), []
    for g in range(12):
        base = [f"w{r.randrange(5000)}" for _ in range(r.choice([4, 60, 400, 1500]))]
        for _ in range(r.choice([1, 5, 25])):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(own) // 40))):
                own[r.randrange(len(own))] = f"z{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (None, rows[0][1]), (None, "only here"), (5, rows[5][1])]
    sets = {i: plain_set(t) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    near = low = 0
    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                near += 1
                low += len(sets[a] & sets[b]) < 0.9 * len(sets[a] | sets[b])
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    assert low > 50 and near > low
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x["id"], x["component_id"]) for x in near_copies.near_duplicates(df).collect()}
    assert {g for g in got if g[0] is not None} == {(i, top(i)) for i in sets} and got - {g for g in got if g[0] is not None} == {(None, top(0)), (None, None)}
    kept = [x["doc_id"] for x in cp.near_duplicates(spark, df, "").collect()]
    assert sorted(k for k in kept if k is not None) == sorted(i for i in sets if top(i) == i) and kept.count(None) == 2
    assert near_copies.near_duplicates(df.where("false")).count() == 0


def test_long_entries_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "ENTRY_ROWS", 5)
    monkeypatch.setattr(near_copies, "BLOCK", 7)
    r, rows = random.Random(4), []
    for g in range(3):
        base = [f"w{r.randrange(5000)}" for _ in range(120)]
        for _ in range(40):  # few edits in some, many in others: groups hang together by their middle
            own = list(base)
            for _ in range(r.randint(0, 5)):
                own[r.randrange(len(own))] = f"z{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    assert components_of(spark, rows) == brute(rows)


def brute(rows):
    sets, up = {i: plain_set(t) for i, t in rows}, {i: i for i, _ in rows}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = up[a], up[b]
                up = {k: min(x, y) if v in (x, y) else v for k, v in up.items()}
    return up


def components_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {x["id"]: x["component_id"] for x in near_copies.near_duplicates(df).collect()}


def test_ids_that_stand_for_several_texts(spark):
    words = " ".join(f"w{i}" for i in range(80))
    rows = [(5, "one text by itself with more words"), (5, "and another one that has nothing of it"), (3, words), (5, words + " end"), (5, "one text by itself with more words"), (None, words), (7, words)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string")
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in near_copies.keep_one(df).collect())
    assert kept == sorted([(0, words), (3, words), (5, rows[0][1]), (5, rows[1][1])])


@pytest.mark.parametrize("share", [0.8, 0.85, 0.9])
def test_pairs_meet(share):
    """How many pairs of a similarity have an equal segment and pass the distances."""
    rng, shape = np.random.default_rng(1), near_copies.Shape.of(0.8, 10**6)
    mixers, met, n = near_copies._mixers(shape.lanes), 0, 300
    for _ in range(n):
        size = int(rng.integers(20, 600))
        both = rng.integers(0, 1 << 64, round(2 * size * share / (1 + share)), np.uint64)
        a, b = (near_copies.fingerprint(np.unique(np.concatenate([both, rng.integers(0, 1 << 64, size - len(both), np.uint64)])), mixers) for _ in "ab")
        x, y = (np.unpackbits(v.view(np.uint8), bitorder="little")[: shape.width * shape.segments].reshape(shape.segments, -1) for v in (a, b))
        near = all(np.bitwise_count(a[:k] ^ b[:k]).sum() <= shape.radius(64 * k) for k in (2, shape.lanes))
        met += bool((x == y).all(axis=1).any()) and near
    assert met >= 0.97 * n


@pytest.mark.parametrize("a,b,common", [(4, 5, 4), (5, 6, 5), (8, 10, 8), (9, 9, 8), (12, 15, 12), (13, 14, 12)])
def test_small_sets_meet(a, b, common):
    """Of pairs of small sets at 0.8 or a little more those that have an equal segment pass the distances; nineteen of twenty meet."""
    rng, shape = np.random.default_rng(1), near_copies.Shape.of(0.8, 10**6)
    mixers, met, passed, n = near_copies._mixers(shape.lanes), 0, 0, 400
    for _ in range(n):
        both = rng.integers(0, 1 << 64, common, np.uint64)
        x, y = (near_copies.fingerprint(np.unique(np.concatenate([both, rng.integers(0, 1 << 64, k - common, np.uint64)])), mixers) for k in (a, b))
        u, v = (np.unpackbits(z.view(np.uint8), bitorder="little")[: shape.width * shape.segments].reshape(shape.segments, -1) for z in (x, y))
        equal = bool((u == v).all(axis=1).any())
        met += equal
        passed += equal and all(np.bitwise_count(x[:k] ^ y[:k]).sum() <= shape.radius(64 * k) for k in (2, shape.lanes))
    assert met >= 0.95 * n and passed >= 0.97 * met


def test_segments_cut_the_lanes(spark):
    for n in (10**6, 10**9):
        shape = near_copies.Shape.of(0.8, n)
        fp = np.random.default_rng(2).integers(0, 1 << 64, shape.lanes, np.uint64)
        whole = sum(int(x) << 64 * k for k, x in enumerate(fp))
        df = spark.createDataFrame([(fp.view(np.int64).tolist(),)], "fp array<long>")
        from pyspark.sql import functions as F

        got = df.select(*[shape.key(i, F.col("fp")) for i in range(shape.segments)]).first()
        assert list(got) == [(i << shape.width) + (whole >> i * shape.width & (1 << shape.width) - 1) for i in range(shape.segments)]

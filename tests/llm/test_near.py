"""SimHash, embeddings, WARC, the classifier, the entry and the pipeline against brute force."""

import base64
import hashlib
import io
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from gridlore.llm import components, decontamination, embeddings, near_copies, packing, quality, queries, shared, simhash, warc

SF = "/root/testdata/sf0.001"


def unite(pairs, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    got = {x["node"]: x["root"] for x in components.connected_components(spark.createDataFrame([*pairs, (None, 3)], "u long, v long")).collect()}
    nodes = {n for a, b in pairs if a != b for n in (a, b)}
    assert got == unite([p for p in pairs if p[0] != p[1]], nodes)
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
    if not words:
        return 0
    s = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_and_spark_hash_agree(spark):
    for t in ["", None, "One", "a b c d", "É A\x0bB c  d\te f", "x " * 3000 + "y"]:
        assert int.from_bytes(simhash.fingerprint(t), "big") == plain_fingerprint(t)
    assert spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] % (1 << 64) == plain_fingerprint("a b c d")


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_links_against_brute_force(spark, radius, monkeypatch):
    monkeypatch.setattr(simhash, "ENTRY_ROWS", 7)  # split entries on the way
    monkeypatch.setattr(simhash, "SPLIT_KEYS", 10_000)
    r = random.Random(radius)
    base = [r.getrandbits(64) for _ in range(20)]
    fps = {f ^ sum(1 << b for b in r.sample(range(64), r.randint(0, radius + 2))) for f in base for _ in range(15)}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    links = simhash.links(df, radius)
    got = unite([(a["u"] % (1 << 64), a["v"] % (1 << 64)) for a in links.collect()], fps)
    assert got == unite([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= radius], fps)


def test_near_duplicates(spark):
    t = "the quick brown fox jumps over the lazy dog and runs away into the deep dark wood"
    rows = [(5, t), (3, t.upper()), (9, "other words altogether here now"), (7, None), (8, ""), (None, t), (5, t), (11, " \t")]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, fp int, component_id int")
    got = Counter((r["id"], r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert got == Counter([(5, 3), (3, 3), (9, 9), (7, 7), (8, 7), (None, 3), (5, 3), (11, 7)])
    kept = simhash.keep_one(spark.createDataFrame([*[(*r, 0, 0) for r in rows], (3, t, 0, 0)], df.schema))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 0), (True, 3), (True, 7), (True, 9)]
    assert simhash.near_duplicates(df.where("false")).count() == 0


def test_one_id_with_several_texts_loses_none(spark):
    rows = [(5, "one text by itself with more words"), (5, "and another one that has nothing of it"), (5, "one text by itself with more words"), (7, "AND another one that has nothing of it")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == sorted(rows[:2])


def test_join_spread(spark, monkeypatch):
    monkeypatch.setattr(shared, "SPREAD_KEYS", 4)
    r = random.Random(5)
    many = [(1 if r.random() < 0.4 else r.randrange(400), i) for i in range(3000)] + [(None, -1)]
    n = Counter(k for k, _ in many if k is not None)
    df = shared.join_spread(spark.createDataFrame(many, "k long, i long"), spark.createDataFrame([(k, str(k), c) for k, c in n.items() if k != 7], "k long, name string, n long"), "k", 3000)
    assert sorted(map(tuple, df.select("k", "i", "name").collect())) == sorted((k, i, str(k)) for k, i in many if k not in (7, None))


def test_hubs_meet_where_they_are(spark):
    pairs = [(0, i) for i in range(1, 3000)] + [(i, i + 5000) for i in range(1, 3000, 7)]
    got = components.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert {x["root"] for x in got} == {0} and len(got) == len({n for p in pairs for n in p})


def cosines(x):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T


@pytest.mark.parametrize("block", [2048, 40])
def test_embeddings_against_brute_force(spark, block):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(40, 32))
    x = np.concatenate([centre[i] + rng.normal(size=(25, 32)) * rng.uniform(0, 0.12) for i in range(40)] + [np.repeat(centre[:1], 30, 0)]).astype(np.float32)
    label = rng.integers(0, 2, len(x))
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))]
    odd = [(2000, None, 1), (2001, [0.0] * 32, 1), (2002, [float("nan")] * 32, 1), (2003, x[0].tolist(), None), (2004, [None] * 32, 0), (2005, [1.0, 2.0], 0), (2006, [], 0), (2007, [float("inf")] + [1.0] * 31, 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<float>, label int, cls int")
    s = embeddings.Settings(leaf_size=60, leaf_block=block)
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, s=s).collect()}
    assert len(got) == len(rows) + len(odd)
    near = (cosines(x.astype(float)) >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    n = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (n <= near.sum(axis=1)).all() and n.sum() >= 0.9 * near.sum() > 1000
    if n.sum() == near.sum():
        assert {i: got[i]["component_id"] for i in range(len(x))} == unite([(a, b) for a, b in zip(*np.nonzero(near))], range(len(x)))
    for i, *_ in odd:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def test_recall_on_the_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(df).collect()}
    want = found = 0
    for _, g in df.toPandas().groupby("label"):
        n = (cosines(np.array(g.embedding.tolist(), float)) >= 0.98).sum(axis=1) - 1
        own = np.array([got[i] for i in g.vec_id])
        assert (own <= n).all()
        want, found = want + n.sum(), found + own.sum()
    assert found >= 0.9 * want


def test_warc_records(spark):
    pages = [(1, "http://a b\n/", "x"), (3, None, "x"), (2, "u", "x"), (4, "u", ""), (5, "u", None), (None, "u", "x"), (None, "u", "only"), (6, "u", "é" * 50_000), (3, None, "x")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, sha1 int")
    m = warc.write(df)
    rows = warc.read(m, m.folder, with_payload=True).collect()
    assert all(r["gap"] is None for r in rows) and len(rows) == len(pages)
    got = Counter((r["record_id"] if r["record_id"].startswith("urn:x-page") else None, r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in rows)
    d = lambda t: (len(t.encode()), base64.b32encode(hashlib.sha1(t.encode()).digest()).decode())
    p = "urn:x-page:"
    assert got == Counter([(p + "1", "revisit", p + "3", *d("x")), (p + "2", "revisit", p + "3", *d("x")), (p + "3", "response", None, *d("x")), (p + "3", "response", None, *d("x")), (None, "revisit", p + "3", *d("x")), (None, "response", None, *d("only")), (p + "4", "revisit", p + "5", *d("")), (p + "5", "response", None, *d("")), (p + "6", "response", None, *d("é" * 50_000))])
    large = warc.write(df, revisit_bytes=2)
    assert Counter(r["record_type"] for r in warc.read(large, large.folder).collect()) == {"response": 9}
    none = warc.write(df.where("false"))
    assert warc.read(none, none.folder).count() == 0


def test_archives_grow_in_number_and_are_read_by_a_task_each(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    r = random.Random(3)
    pages = [(i, "u", "" if i % 3 == 0 else format(r.getrandbits(20_000 if i % 5 else 8), "x")) for i in range(400)]
    m = warc.write(spark.createDataFrame(pages, "page_id long, url string, html string"))
    files = m.collect()
    out = warc.read(m, m.folder)
    assert len(files) > 20 and max(f["bytes"] for f in files) < 40_000 and out.rdd.getNumPartitions() == len(files)
    got, last = out.collect(), max(i for i, _, t in pages if not t)
    assert Counter(r["record_id"] for r in got) == Counter(f"urn:x-page:{i}" for i, *_ in pages)
    assert {r["refers_to"] for r in got if r["payload_bytes"] == 0} == {None, f"urn:x-page:{last}"}


def member(b):
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(b) + c.flush()


@pytest.mark.parametrize("gz", [True, False])
def test_salvage(gz):
    r = random.Random(2)
    records = [warc.record("response", f"urn:x-page:{i}", "http://a/", "2024-01-01T00:00:00Z", bytes(r.randrange(256) for _ in range(i * 30)), "D", i * 30) for i in range(30)]
    parts = [member(x) if gz else x for x in records]
    at = np.cumsum([0, *map(len, parts)])
    for case in range(30):
        whole, hurt = bytearray(b"".join(parts)), r.sample(range(1, 30), 2)
        for k in hurt:
            j = int(at[k]) + r.randrange(40 if gz else 300, len(parts[k]) - 12) if len(parts[k]) > 340 else int(at[k]) + len(parts[k]) // 2
            whole[j] ^= 1 << r.randrange(8)
        data = bytes(whole[: len(whole) - 5]) if case % 3 == 0 else bytes(whole)
        out = list(warc.salvage(io.BytesIO(data)))
        names = {x[3]["warc-record-id"] for x in out if x[0] == "record"}
        lost = {k for k in range(30) if f"<urn:x-page:{k}>" not in names}
        assert lost <= {*hurt, *([29] if case % 3 == 0 else [])}
        edges = sorted((x[1], x[2]) for x in out)
        assert edges[0][0] == 0 and edges[-1][1] == len(data) and all(a[1] >= b[0] for a, b in zip(edges, edges[1:]))
    assert [x[0] for x in warc.salvage(io.BytesIO(b"nothing here"))] == ["gap"] and list(warc.salvage(io.BytesIO(b""))) == []


def test_classifier(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    s = quality.Settings(sample_rows=2000)
    scorer = quality.train(docs, labels, s, teach=~F.expr(queries.HELD_OUT))
    held = quality.score(docs.join(labels, "doc_id").where(F.expr(queries.HELD_OUT)).select("text", "quality"), scorer).toPandas()
    assert ((held.score >= 0.3) == held.quality).mean() > 0.97
    odd = spark.createDataFrame([(None,), ("",), ("x " * 100_000,), ("a",), ("a",)], "text string")
    got = [r["score"] for r in quality.score(odd, scorer).collect()]
    assert all(0 <= p <= 1 for p in got) and got[0] == got[1] and got[3] == got[4]
    assert quality.score(odd.where("false"), scorer).count() == 0
    none = quality.train(docs, labels.where("false"), s)
    assert {r["score"] for r in quality.score(odd, none).collect()} == {0.5}


def test_scores_are_the_model(monkeypatch):
    s = quality.Settings(epochs=2)
    m = quality.Model(s).fit(["good good words here", "bad %%% bad"] * 20, [1, 0] * 20)
    text = "good words words %%% new words"
    own = quality.words(text)
    vectors = [m.table[quality.features(w, s)].mean(axis=0) for w in own]
    times, mask = [int(t) for t in quality._TIMES], (1 << 64) - 1
    for n in (2, 3):
        for i in range(len(own) - n + 1):
            h = sum(quality.word_hash(w) * times[k] for k, w in enumerate(own[i : i + n])) & mask
            vectors.append(m.table[((((h ^ h >> 29) * times[-1]) & mask) >> 32) % s.rows])
    vectors += [m.table[quality._RETURNS[k] % s.rows] for k in (0, 2)]  # words: after 1, after 3
    z = np.mean(vectors, axis=0) @ m.weight + m.bias
    want = pytest.approx(1 / (1 + np.exp(z[0] - z[1])), abs=1e-6)
    assert m.scorer()(text) == want
    monkeypatch.setattr(quality, "CACHE_WORDS", 2)  # the cache turns over
    known = quality.Known()
    assert [m.scorer()(t, known) for t in (text, "other", text)][::2] == [want, want] and m.scorer()("") == m.scorer()(None)


def test_bags_are_kept_deflated():
    r = random.Random(5)
    texts = [None, "", "a", "a " * 5000, " ".join(f"w{r.randrange(9000)}" for _ in range(40_000)), *(" ".join(f"v{r.randrange(50)}" for _ in range(r.randrange(60))) for _ in range(20))]
    for s in (quality.Settings(), quality.Settings(rows=1 << 20)):
        bags = [quality.bag(t, s, {}) for t in texts]
        kept = quality.Bags(pa.chunked_array([[quality.packed(*b) for b in bags[:3]], [quality.packed(*b) for b in bags[3:]]], pa.binary()))
        assert len(kept) == len(bags)
        for (rows, share), (r2, s2) in zip(bags, (kept[i] for i in range(len(bags)))):
            assert rows.tolist() == r2.tolist() and share.tolist() == s2.tolist() and s2.dtype == np.float32
        y = [i % 2 for i in range(len(bags))]
        a, b = (quality.Model(s).fit_bags(d, y) for d in (bags, kept))
        assert (a.table == b.table).all() and (a.weight == b.weight).all()


def test_training_against_a_plain_version():
    """Steps of a slow version without hashing tricks: one vector for each feature of the whole text."""
    s = quality.Settings(epochs=1, sample_rows=8)
    texts, y = ["a b a", "c d", "a c " * 3, "d d d"], [1, 0, 1, 0]
    fast = quality.Model(s).fit(texts, y)
    slow = quality.Model(s)
    slow.bias[:] = np.log((np.bincount(y) + 1) / 6)
    bags = []
    for t in texts:
        own, bag = quality.words(t), Counter()
        for w in own:
            for r in quality.features(w, s):
                bag[r] += 1 / len(quality.features(w, s))
        h = np.array([quality.word_hash(w) for w in own], np.uint64)
        extra = [int(r) for x in (*quality.ngram_rows(h, s), quality.return_rows(h, s)) for r in x]
        bag.update(Counter(extra))
        n = len(own) + len(extra)
        bags.append({r: c / n for r, c in bag.items()})
    for step, i in enumerate(np.random.default_rng(s.seed).permutation(4)):
        rate, bag = s.rate * (1 - step / 4), bags[i]
        x = sum(c * slow.table[r] for r, c in bag.items())
        p = np.exp(x @ slow.weight + slow.bias)
        p = p / p.sum() - np.eye(2)[y[i]]
        back = slow.weight @ p
        slow.weight -= rate * np.outer(x, p)
        slow.bias -= rate * 0.1 * p
        norm = sum(c * c for c in bag.values()) ** 0.5
        for r, c in bag.items():
            slow.table[r] -= rate / norm * c * back
    assert np.allclose(fast.table, slow.table, atol=1e-5) and np.allclose(fast.weight, slow.weight, atol=1e-5)


def test_rare_words_of_a_long_text_teach():
    r = random.Random(2)
    texts = [" ".join(r.choice(["tar", "vel", "mon", "sed", "lin"]) + str(r.randrange(60)) for _ in range(300)) for _ in range(400)]
    texts = [t if i % 2 else f"{t[:900]} zzqx {t[900:]} end zzqx end zzqx" for i, t in enumerate(texts)]
    score = quality.Model(quality.Settings(epochs=20)).fit(texts[:340], [i % 2 for i in range(340)]).scorer()
    assert np.mean([(score(t) >= 0.5) == i % 2 for i, t in enumerate(texts[340:])]) > 0.9


def test_entry_has_a_query_for_each_operator():
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in e.queries()


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, at, kept = [n for n, _ in cp.STAGES], docs, [docs.toPandas()]
    for _, step in cp.STAGES[:-1]:
        at = step(spark, at, SF)
        assert at.columns == docs.columns
        kept.append(at.toPandas())
    assert names == ["quality classifier", "near duplicates", "benchmark decontamination", "best-fit packing"]
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    good = set(labels[labels.quality == 1].doc_id)
    assert len(good & set(kept[0].doc_id) - set(kept[1].doc_id)) <= 0.02 * len(good)
    sets = {i: set(near_copies.shingles(t).tolist()) for i, t in zip(kept[1].doc_id, kept[1].text)}
    roots = unite([(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))], sets)
    assert set(kept[2].doc_id) == {i for i, r in roots.items() if i == r}
    items = [decontamination.words(t) for t in spark.read.parquet(f"{SF}/benchmark.parquet").toPandas().text]
    for i, t in zip(kept[2].doc_id, kept[2].text):
        if any(f" {' '.join(w)} " in f" {' '.join(decontamination.words(t))} " for w in items):
            assert i not in set(kept[3].doc_id)
    out = cp.run(spark, SF).toPandas()
    assert set(out.doc_id) == set(kept[3].doc_id) and out.groupby("sequence_id").length.sum().max() <= packing.CAPACITY

"""Token counts, licences, chats, tiling, token files and packing on small inputs, against brute force or the library."""

import io
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlore.llm import chat, decontamination, licences, packing, token_counts, token_files, tokens

DOCS = "doc_id long, text string, id string, score double, start int"
ODD = ["a", "b", " ", "  ", "\n", "\n\n", "\t", "'s", "é", "!", "...", "12", "'ll", "\r\n", " ", "\x1c", "\x85", " x", "日本", "<|endoftext|>", "🙂", "."]


def texts(n=200, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, 30))) for _ in range(n)] + ["", " ", "word " * 30_000]


def frame(spark, rows):
    """Extra columns have names that the operators use."""
    return spark.createDataFrame([(i, t, "x", 0.5, 1) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def bpe():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_library(bpe):
    known = tokens.WordIds(tokens.default_path(), most=50)  # generations turn over all the time
    for t in texts():
        assert np.frombuffer(known(t), "<u4").tolist() == bpe.encode(t, add_special_tokens=False).ids, repr(t)
    assert known(None) == b""


def library(pieces, byte_pieces):
    from tokenizers import Tokenizer, models, pre_tokenizers

    low = min(s for _, s in pieces)
    vocab = [("<unk>", low), *pieces] + [(f"<0x{b:02X}>", low) for b in range(256)] * byte_pieces
    t = Tokenizer(models.Unigram(vocab, 0, byte_pieces))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


@pytest.mark.parametrize("byte_pieces", [True, False])
def test_counts_equal_the_library_with_ties(byte_pieces):
    r = random.Random(3)
    for _ in range(60):
        pieces = tuple({"".join(r.choice("▁abc") for _ in range(r.randint(1, 4))): -float(r.randint(1, 3)) for _ in range(r.randint(3, 12))}.items())
        lib, own = library(pieces, byte_pieces), token_counts.Counter(token_counts.Vocabulary(pieces, byte_pieces))
        for _ in range(20):
            t = "".join(r.choice("abcdé ") for _ in range(r.randint(0, 12)))
            assert own(t) == len(lib.encode(t, add_special_tokens=False).ids), (pieces, t)


def test_counts_of_the_real_vocabulary(spark):
    v = token_counts.from_sentencepiece()
    lib = library(v.pieces, True)
    rows = list(enumerate(texts(100) + ["word"]))
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count(frame(spark, [*rows, (999, None)]), v).collect()}
    assert got == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in rows} | {999: 0}
    assert token_counts.count(frame(spark, []), v).count() == 0
    with pytest.raises(ValueError):
        token_counts.Vocabulary(())


@pytest.fixture(scope="module")
def licence_model():
    return licences.train()


def brute_licence(m, text):
    import re

    out = []
    for k, p in enumerate(re.split(r"\n[ \t]*\n\s*|(?<=[.!?])[ \t]*\n", text.lower())):
        w = [x for x in re.split(r"[\W_]+", p) if x]
        if not set(w) & set(m.keys):
            continue
        grams = set(licences.ngrams(w))
        z = np.array(m.bias) + sum((np.array(m.weights[g]) for g in grams if g in m.weights), np.zeros(len(m.bias)))
        e = np.exp(z / m.temperature)
        top = int(e.argmax())
        if e.sum() / (1 + e.sum()) > 0.5:
            share = max(len(grams & set(t)) / len(t) for f, t in m.templates if f == m.families[top])
            sure = e[top] / (1 + e.sum()) >= m.least and share >= m.similarity
            out.append((k, m.families[top] if sure else "unknown", round(float(e[top] / (1 + e.sum())), 6)))
    return out


def test_licences(spark, licence_model):
    m = licence_model
    rows = [(1, "Foo bar.\nReleased under the MIT License.\nhello"), (2, "This work is licensed under the GNU General Public License, version 2."), (3, "She has a license to drive a car to the old town."), (4, None), (5, ""), (6, "Licensed under the Frobnicate Public License.\n\nLicensed under CC BY-NC 3.0."), (7, "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated\ndocumentation files, to deal in the Software without restriction"), (7, "Released under the MIT License."), (None, "Licensed under the Apache License, Version 2.0.")]
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["paragraph"], r["family"], round(r["probability"], 6)) for r in licences.scan(frame(spark, rows), m).collect())
    want = sorted((i is not None, i or 0, *x) for i, t in rows if t for x in brute_licence(m, t))
    assert got == want
    assert {(i, f) for _, i, _, f, _ in got} == {(0, "Apache"), (1, "MIT"), (2, "GPL"), (6, "unknown"), (6, "CC-BY-NC"), (7, "MIT")}
    assert licences.scan(frame(spark, []), m).count() == 0


def test_licence_scan_is_native(spark, licence_model):
    plan = licences.scan(frame(spark, [(1, "x")]), licence_model)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_quotes(spark):
    rows = [(1, 0, "a", "Hello there\nHow are you?\n\nSecond para"), (1, 1, "b", "> Hello there\n> How are you?\n\nFine"), (1, 2, "a", "On Monday b wrote:\n>> Hello there\n> Fine\nok\n"), (1, 3, "c", "> second   PARA\nyes"), (2, 0, "a", None), (2, 1, "b", "> Hello there"), (None, 1, "x", "> hi\nho"), (1, 3, "c", "> second   PARA\nyes"), (3, None, "q", "t")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, g int, hash int")
    got = [(r["conv_id"], r["position"], r["turn"], r["text"], r["reply_to"], r["depth"], r["n_quotes"]) for r in chat.link(df).orderBy(F.col("conv_id").asc_nulls_first(), "position").collect()]
    assert got == [
        (None, 0, 1, "ho", None, 0, 1), (1, 0, 0, "Hello there\nHow are you?\n\nSecond para", None, 0, 0), (1, 1, 1, "Fine", 0, 1, 1), (1, 2, 2, "ok", 1, 2, 2), (1, 3, 3, "yes", 0, 1, 1), (1, 4, 3, "yes", 0, 1, 1), (2, 0, 0, "", None, 0, 0), (2, 1, 1, "", 0, 1, 1), (3, 0, None, "t", None, 0, 0),
    ]
    assert chat.link(df.where("false")).count() == 0


def test_the_first_level_decides(spark):
    rows = [(1, 0, "a", "one\ntwo\nthree"), (1, 1, "b", "> one\nmine"), (1, 2, "a", ">> one\n>> two\n>> three\n> mine\nlast"), (1, 3, "c", "> one\n> two\nelse"), (1, 4, "c", "> last\nend"), (1, 5, "c", ">> mine\nno first level")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["turn"]: (r["reply_to"], r["depth"], r["n_linked"], r["n_deeper"], r["position"]) for r in chat.link(df).collect()}
    # 5 has no link of the first level: it replies to the message before it
    assert got == {0: (None, 0, 0, 0, 0), 1: (0, 1, 1, 0, 1), 2: (1, 2, 1, 4, 2), 4: (2, 3, 1, 0, 3), 5: (4, 4, 0, 1, 4), 3: (0, 1, 2, 0, 5)}


def test_long_trees(spark):
    """Reply order and depth of one long conversation against a plain walk."""
    r, rows, up = random.Random(3), [], {}
    for i in range(700):
        up[i] = None if not i else r.choice([i - 1, i - 1, r.randrange(i), max(0, i - 2)])
        rows.append((4, i, "u", f"message number {i}" if up[i] in (None, i - 1) else f"> message number {up[i]}\nmessage number {i}"))
    got = {x["turn"]: (x["position"], x["depth"], x["reply_to"]) for x in chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    want, stack = {}, [(0, 0)]
    while stack:
        i, d = stack.pop()
        want[i] = (len(want), d, up[i])
        stack += [(k, d + 1) for k in sorted((k for k in up if up[k] == i), reverse=True)]
    assert got == want


def test_quotes_against_sql(spark):
    import duckdb

    from gridlore.llm.queries import CHAT_SQL

    r = random.Random(8)
    parts = ["Hello there", "> Hello there", ">> Hello there", "How are you?", "> how ARE  you?", "", "On Monday b wrote:", "Fine", "> Fine", " > Fine", ">>fine", "a > b", "\r", "> "]
    rows = [(None if r.random() < 0.05 else r.randrange(6), None if r.random() < 0.05 else r.randrange(8), r.choice("ab"), None if r.random() < 0.05 else "\n".join(r.choice(parts) for _ in range(r.randint(0, 6)))) for _ in range(150)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    conversations = df.toArrow()  # noqa: F841  read by name
    cols = ["conv_id", "position", "turn", "role", "text", "reply_to", "root", "depth", "n_quotes", "n_linked", "n_deeper"]
    got = Counter(tuple(x[c] for c in cols) for x in chat.link(df).collect())
    want = Counter(duckdb.sql(f"select {', '.join(cols)} from ({CHAT_SQL})").fetchall())
    assert got == want


def test_quote_links_go_to_the_latest_earlier_turn(spark):
    df = spark.createDataFrame([(1, i, "u", "same words" if i < 4 else "> same words\nmore") for i in range(6)], "conv_id long, turn long, role string, text string")
    got = {r["turn"]: (r["reply_to"], r["n_linked"]) for r in chat.link(df).collect()}
    assert got[4] == (3, 1) and got[5] == (3, 1) and got[3] == (2, 0)


def naive_tiling(doc, item, k):
    """Longest unmarked common runs, first in the item, then in the document."""
    dm, im, out = [False] * len(doc), [False] * len(item), []
    while True:
        best = None
        for q in range(len(item)):
            for p in range(len(doc)):
                n = 0
                while q + n < len(item) and p + n < len(doc) and item[q + n] == doc[p + n] and not im[q + n] and not dm[p + n]:
                    n += 1
                if n >= k and (best is None or (-n, q, p) < best):
                    best = (-n, q, p)
        if best is None:
            return sorted(out)
        n, q, p = -best[0], best[1], best[2]
        out.append((p, q, n))
        im[q : q + n], dm[p : p + n] = [True] * n, [True] * n


def test_tiling_against_naive():
    r = random.Random(5)
    for _ in range(150):
        item = [r.choice("abcde") for _ in range(r.randint(3, 25))]
        doc = [r.choice("abcdef") for _ in range(r.randint(0, 20))] + item[r.randint(0, 9) :] + [r.choice("abcdef") for _ in range(r.randint(0, 20))] + item[:9]
        k = min(3, len(item))
        assert sorted(decontamination.tile(doc, item, k)) == naive_tiling(doc, item, k)


def test_words_that_come_back_cost_no_more():
    import time

    began = time.time()
    assert decontamination.tile(["x"] * 40_000, ["x"] * 400, 5) == [(0, 0, 400)]
    assert len(decontamination.tile((["x"] * 7 + ["y"]) * 5000, ["x"] * 400, 5)) == 57
    assert time.time() - began < 5


def test_seeds_do_not_depend_on_their_place():
    r = random.Random(4)
    text = [r.choice("abcdef") for _ in range(300)]
    h = decontamination.seeds(decontamination.Running(text), 4)
    by_words = {}
    for i, x in enumerate(h.tolist()):
        by_words.setdefault(tuple(text[i : i + 4]), set()).add(x)
    assert all(len(v) == 1 for v in by_words.values()) and len({x for v in by_words.values() for x in v}) == len(by_words)
    assert set(decontamination.seeds(decontamination.Running(text[7:90]), 4).tolist()) <= set(h.tolist())


def test_common_seeds_and_parts_of_long_items(spark):
    """Items that all begin alike, against every pair; an item of which a document has a long part."""
    r = random.Random(9)
    head = "answer the following question with one of these words".split()
    items = [(i, " ".join(head + [f"w{r.randrange(400)}" for _ in range(r.randint(1, 40))])) for i in range(60)] + [(90, " ".join(f"v{i}" for i in range(180)))]
    docs = [(i, " ".join(head + [f"w{r.randrange(400)}" for _ in range(50)])) for i in range(30)]
    docs += [(100 + i, f"so {t} end" if i % 2 else " ".join(t.split()[len(t.split()) // 3 :])) for i, t in items]
    docs += [(500, " ".join(f"v{i}" for i in range(60, 112))), (501, " ".join(f"v{i}" for i in range(60, 105)))]
    want = {(d, i): round(found[0], 9) for d, t in docs for i, u in items if (found := decontamination.leak(decontamination.words(t), decontamination.words(u)))}
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = frame(spark, docs)
    got = {(x["doc_id"], x["item_id"]): round(x["coverage"], 9) for x in decontamination.leaks(df, bench).collect()}
    assert got == want and (500, 90) in got and (501, 90) not in got and len(want) > 50
    kept = decontamination.clean(df, bench)
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted({d for d, _ in docs} - {d for d, _ in want}) and kept.columns == df.columns


def test_leaks(spark):
    item = " ".join(f"w{i}" for i in range(20))
    moved = " ".join([*item.split()[12:], "zz", *item.split()[:12]])
    docs = frame(spark, [(1, f"before {item} after"), (2, moved.upper()), (3, " ".join(f"w{i}" for i in range(9))), (4, None), (5, ""), (1, item), (None, item), (6, "yes no"), (7, "x " * 50_000 + item)])
    bench = spark.createDataFrame([(1, item, 1), (2, None, 1), (3, "", 1), (4, "yes no", 1), (5, item, 1)], "item_id long, text string, doc_id int")
    got = Counter((r["doc_id"], r["item_id"], len(r["tiles"])) for r in decontamination.leaks(docs, bench).collect())
    assert got == Counter({(d, i, n): c for d, n, c in ((1, 1, 2), (2, 2, 1), (None, 1, 1), (7, 1, 1)) for i in (1, 5)} | {(6, 4, 1): 1})
    kept = decontamination.clean(docs, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5] and kept.columns == docs.columns
    assert decontamination.leaks(docs, bench.where("false")).count() == 0 and decontamination.leaks(docs.where("false"), bench).count() == 0


def test_simple8b_round_trip():
    r = random.Random(7)
    for _ in range(120):
        n, top = r.choice([0, 1, 5, 1023, 1024, 1025, 3000]), r.choice([1, 2, 300, 50_257, 1 << 40, 1 << 64])
        ids = np.array([r.randrange(top) if r.random() < 0.9 else 0 for _ in range(n)], np.uint64)
        words, per = token_files.pack(ids)
        counts = np.array([1024] * (n // 1024) + [n % 1024] * bool(n % 1024), np.int64)
        back = token_files.unpack(words, counts, np.concatenate([[0], np.cumsum(per)])) if n else ids
        assert np.array_equal(back, ids)


def test_file_round_trip_in_small_steps(monkeypatch):
    monkeypatch.setattr(token_files, "IDS_AT_ONCE", 1024)
    r, docs = random.Random(2), []
    for i in range(40):
        docs.append((i if i else None, np.array([r.randrange(50_000) for _ in range(r.choice([0, 3, 900, 5000]))], "<u4")))
    told = {}
    f = io.BytesIO(b"".join(token_files.file_chunks(((i, x.tobytes()) for i, x in docs), told)))
    got = list(token_files.read_file(f))
    assert [i for i, _ in got] == [i for i, _ in docs] and all(np.array_equal(a[1], b[1]) for a, b in zip(got, docs)) and told["docs"] == 40
    with pytest.raises(ValueError):
        list(token_files.read_file(io.BytesIO(b"x" * 40)))


def test_token_files(spark, bpe):
    rows = list(enumerate(texts(60))) + [(500, None), (7, "again"), (7, "again")]
    random.Random(1).shuffle(rows)
    got = token_files.read(token_files.write(frame(spark, rows)), with_ids=True).orderBy("start").collect()
    at = 0
    assert [r["doc_id"] for r in got] == sorted(i for i, _ in rows)
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    by_text = Counter((i, tuple(bpe.encode(t or "", add_special_tokens=False).ids + [0])) for i, t in rows)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == by_text
    assert token_files.read(token_files.write(frame(spark, []))).count() == 0


def test_files_grow_in_number_and_are_read_by_a_task_each(spark, monkeypatch):
    monkeypatch.setattr(token_files, "PART_BYTES", 4000)
    monkeypatch.setattr(token_files, "FILE_TOKENS", 300)
    r = random.Random(6)
    # half the rows have one id, a tenth none
    rows = [(None if i % 10 == 0 else 7 if i % 2 else r.randrange(1000), " ".join(r.choice("one two three".split()) for _ in range(r.randint(0, 60)))) for i in range(500)]
    m = token_files.write(frame(spark, rows))
    files = m.collect()
    assert len(files) > 40 and len({f["part"] for f in files}) > 6 and max(f["docs"] for f in files) < 60
    out = token_files.read(m, with_ids=True)
    assert out.rdd.getNumPartitions() == len(files)
    got = out.orderBy("start", "n_tokens").collect()
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and Counter(ids) == Counter(i for i, _ in rows)
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()


def optimum(sizes, room):
    best = len(sizes)

    def go(left, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not left:
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + left[0] <= room and bins[i] not in bins[:i]:
                go(left[1:], [*bins[:i], bins[i] + left[0], *bins[i + 1 :]])
        go(left[1:], [*bins, left[0]])

    go(sorted(sizes, reverse=True), [])
    return best


def test_packing_reaches_the_optimum_of_small_cases():
    r = random.Random(9)
    for _ in range(150):
        room = r.choice([10, 17, 30])
        sizes = [r.randint(1, room) for _ in range(r.randint(0, 9))]
        found, bound = packing.complete(Counter(sizes), room)
        assert Counter(s for p, k in found for s, m in p for _ in range(m * k)) == Counter(sizes)
        assert all(sum(s * m for s, m in p) <= room for p, _ in found)
        assert bound <= optimum(sizes, room) == sum(k for _, k in found), (room, sizes)


def test_search_improves_on_best_fit():
    import pyarrow.parquet as pq

    texts_ = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    counts = Counter(n for raw in tokens.encode(texts_, tokens.default_path()) for _, n in packing.spans(len(raw) // 4 + 1, packing.CAPACITY))
    found, bound = packing.complete(counts)
    got = Counter()
    for p, k in found:
        assert sum(s * m for s, m in p) <= packing.CAPACITY
        for s, m in p:
            got[s] += k * m
    assert got == counts
    assert bound <= sum(k for _, k in found) <= 963 < sum(k for _, k in packing.best_fit(counts, packing.CAPACITY))


def test_fillings_are_the_undominated_ones():
    from itertools import combinations

    r = random.Random(4)
    for _ in range(60):
        sizes = [r.randint(1, 20) for _ in range(r.randint(1, 8))]
        room, top = 20, max(sizes)
        rest = sizes.copy()
        rest.remove(top)
        every = {tuple(sorted((top, *c), reverse=True)) for n in range(len(rest) + 1) for c in combinations(rest, n) if top + sum(c) <= room}
        got = [tuple(x for x, m in p for _ in range(m)) for p, _ in packing.fillings(Counter(sizes), room, room)]
        assert len(set(got)) == len(got) and set(got) <= every
        for f in every - set(got):  # one length left over stands for one or two of the filling
            left, own, waste = Counter(sizes) - Counter(f), list(f), room - sum(f)
            own.remove(top)
            sums = {x for x in own} | {x + y for i, x in enumerate(own) for y in own[i + 1 :]}
            assert any(y <= x <= y + waste and x not in (y,) * (y in own) for x in left for y in sums)


def test_pack(spark, bpe):
    rows = list(enumerate(texts(60))) + [(500, None), (7, "again"), (7, "again"), (None, "null id")]
    got = packing.pack(frame(spark, rows), capacity=256, keep_ids=True).toPandas()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1].tolist()] and g.length.sum() <= 256
    want = Counter()
    for i, t in rows:
        ids = bpe.encode(t or "", add_special_tokens=False).ids + [2]
        for k, (s, n) in enumerate(packing.spans(len(ids), 256)):
            want[i, k, s, tuple(ids[s : s + n])] += 1
    assert Counter((None if i != i else int(i), k, s, tuple(x)) for i, k, s, x in zip(got.doc_id, got.piece, got.start, got.ids)) == want
    assert list(packing.spans(2500, 1024)) == [(0, 452), (452, 1024), (1476, 1024)]
    assert packing.pack(frame(spark, [])).count() == 0


def test_equal_items_are_a_class_and_texts_stay_out_of_broadcasts(spark):
    """Thousands of equal items, items alike but for a word, one item in many documents and one document with many items, against every pair."""
    r = random.Random(12)
    same, form = " ".join(f"e{i}" for i in range(12)), [f"f{i}" for i in range(10)]
    alike = [(10_000 + i, " ".join([*form, f"x{i}"])) for i in range(600)]
    items = [(i, same) for i in range(3000)] + alike + [(20_000, "another item of some words here")]
    docs = [(i, f"so {same} and another item of some words here {r.random()}") for i in range(30)] + [(50, " . ".join(t for _, t in alike)), (51, "nothing of it"), (52, same[:20])]
    bench, df = spark.createDataFrame(items, "item_id long, text string"), frame(spark, docs)
    distinct = {t: [j for j, u in items if u == t] for _, t in items}
    want = Counter((d, j) for d, t in docs for u, ids in distinct.items() if decontamination.leak(decontamination.words(t), decontamination.words(u)) for j in ids)
    got = Counter((x["doc_id"], x["item_id"]) for x in decontamination.leaks(df, bench).select("doc_id", "item_id").collect())
    assert got == want and got[(50, 10_599)] == 1 and got[(0, 2999)] == 1
    found, _, members = decontamination._found(df, bench, "doc_id", "text", "item_id", "text", 5, 0.6, 50)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert all("text" not in line for line in plan.splitlines() if "BroadcastExchange" in line)
    assert max(len(x["values"]) for x in members.collect()) < 2 * decontamination.LIST


def test_salted_joins_keep_all_rows(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "SPREAD_KEYS", 4)
    many = spark.range(4000).selectExpr("id as doc", "if(id % 3 = 0, id % 7, 100) as item")
    one = spark.range(101).selectExpr("id as item", "cast(id as string) as text")
    got = decontamination._salted(many, many.groupBy("item").count().withColumnRenamed("count", "n"), one, "item", "doc", 4000)
    assert sorted(tuple(x) for x in got.select("doc", "item", "text").collect()) == sorted((x["doc"], x["item"], str(x["item"])) for x in many.collect())


def test_a_long_way_of_replies(spark):
    """Each message answers the one before the last: two ways, each half as long as the conversation; what is staged grows with the messages alone."""
    from pathlib import Path
    from urllib.parse import urlparse

    from gridlore.llm import shared

    root, sizes = Path(urlparse(shared.shared_dir(spark)).path), {}
    for n in (500, 2000):
        before = set(root.iterdir()) if root.exists() else set()
        rows = [(1, i, "u", f"message number {i}" if i < 2 else f"> message number {i - 2}\nmessage number {i}") for i in range(n)]
        out = chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
        got = [x["turn"] for x in out.orderBy("position").collect()]
        assert got == [0, *range(1, n, 2), *range(2, n, 2)]
        made = [p for p in set(root.iterdir()) - before if p.name.startswith(("trees", "starts", "siblings", "hung", "places"))]
        sizes[n] = sum(f.stat().st_size for p in made for f in p.rglob("*.parquet"))
    assert sizes[2000] < 5 * sizes[500]

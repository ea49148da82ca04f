"""The filter audit against a plain run of every order, and its defined cases."""

import random
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from gridlore.llm import audit, queries_more, shared

DOCS = "doc_id long, text string, source string, mask string, n long"


def plain(docs, labels):
    """Row by row, order by order."""
    good = {i for i, q, t in labels if q == 1 and i is not None}
    toxic = {i for i, q, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    rows = []
    for i, t, s, *_ in docs:
        t = t or ""
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > least[t]}
        rows.append((s or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine, share = [r for r in rows if r[0] == part], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                here, left = [r for r in left if r[1][f]], [r for r in left if not r[1][f]]
                share[f] += len(here)
                failing = [r for r in mine if r[1][f]]
                out[part, order, step] = [len(left), len(here), len(failing) - len(here), sum(sum(r[1].values()) == 1 for r in failing), sum(r[2] for r in here), sum(r[3] for r in here)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(share[order[step - 1]])
    return out


def texts(seed, n):
    r = random.Random(seed)
    pool = ["", None, " \t ", "A" * 40, "a b " * 60, "é Ü " * 3, "x # y", "\x0b".join(f"w{i}" for i in range(80))]
    return pool + [" ".join(r.choice(["w%d" % r.randrange(90), "UP", "a|b", "ça"]) for _ in range(r.randrange(120))) for _ in range(n)]


def audited(spark, docs, labels):
    got = audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got.collect()}


def test_equals_every_order_applied(spark):
    r, pool = random.Random(5), texts(1, 40)
    docs = [(i, r.choice(pool), r.choice(["s", "t", "", None]), "x", 9) for i in range(160)] + [(None, "a b", "s", "", 1)] * 3 + [(7, "same", "t", "", 1)] * 2 + [(900, "same", "t", "", 1)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 170, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    assert audited(spark, docs, labels) == plain(docs, labels)


def test_a_third_are_copies_and_texts_are_long(spark, monkeypatch):
    monkeypatch.setattr(shared, "SPREAD_KEYS", 2)
    long = "word Word# " * 60_000
    docs = [(i, "hot text" if i % 3 else f"t {i} " * 60, "one", "", 0) for i in range(900)] + [(1000 + i, long, "one", "", 0) for i in range(3)]
    assert audited(spark, docs, [(i, 1, 0) for i in range(900)]) == plain(docs, [(i, 1, 0) for i in range(900)])


def test_steps_add_up(spark):
    """Every order removes the same documents, and the Shapley values share them out."""
    docs = [(i, t, "p", "", 0) for i, t in enumerate(texts(3, 60))]
    got = audited(spark, docs, [])
    assert len(got) == 600 and len({v[0] for (_, _, s), v in got.items() if s == 5}) == 1
    removed = len(docs) - next(v[0] for (_, _, s), v in got.items() if s == 5)
    assert sum({(o[s - 1]): v[6] for (_, o, s), v in got.items()}.values()) == 120 * removed


def test_empty_tables_other_filters_and_names(spark):
    assert audited(spark, [], []) == {}
    docs = spark.createDataFrame([(1, "a", "p", "m", 5), (2, "b", "p", "m", 0)], DOCS)
    got = audit.audit(docs, failures={"N": F.col("n") > 3, "T": F.col("text") == "b"}, duplicates=None).orderBy("filter_order", "step").collect()
    assert [(r.filter_order, r.step, r.kept, r.removed, r.shapley) for r in got] == [("NT", 1, 1, 1, 2), ("NT", 2, 0, 1, 2), ("TN", 1, 1, 1, 2), ("TN", 2, 0, 1, 2)]
    with pytest.raises(ValueError, match="one letter"):
        audit.audit(docs, failures={"NN": F.col("n") > 3})


def test_the_query_is_registered_with_sql():
    assert "op11_filter_interaction_audit" in queries_more.QUERIES and "op11_filter_interaction_audit" in queries_more.ORACLE_SQL

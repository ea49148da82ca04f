"""Filter interaction audit by inclusion and exclusion, DataFrame functions only.

Each document gets its filters' failure flags as bits of one number. For each part and each set S of filters the joint-failure count J(S) is the sum of the
product of the flags in S, with weight 1, with the weight of good and with that of toxic documents. Möbius inversion of the J over the subset lattice gives
everything else, for any order of the filters, without another look at a document:

- documents that survive the filters in P: sum over S within P of (-1)^|S| J(S);
- documents that fail filter i alone: sum over S holding i of (-1)^(|S|-1) J(S);
- Harsanyi dividend of S in the game "documents removed": (-1)^(|S|+1) J(S); a filter's Shapley value is the sum of D(S)/|S| over the S that hold it. All orders
  together count n! of it, a whole number, as every |S| divides n!.

Defined results: a null text counts as empty; a null part is the empty string, as is an empty one; a document is a duplicate if a smaller id has an identical text anywhere in
the table (texts are compared by SHA-256), so a null id is never one nor makes one, and rows of one id and text are none of each other; a document is good or toxic if any of its
labels says so; repeated rows count each; an empty table gives no rows; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import join_spread, stage, unstage

#: A word's characters; ASCII white space divides words.
SPACE = r"[\x20\x09-\x0D]+"
WEIGHTS = ("n", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """A: under 50 words; B: distinct words under 65 % of the words; C: A-Z over 5 % of the code points; D: holds one of #$%&*|."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": n < 50, "B": F.size(F.array_distinct(words)) * 100 < n * 65, "C": capitals * 100 > F.length(text) * 5, "D": text.rlike(r"[#$%&*|]")}


def flagged(docs: DataFrame, failures: Mapping[str, Column], labels: DataFrame | None = None, duplicates: str | None = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and set of failed filters; bit i of mask is the i-th filter, ``duplicates`` the last.

    Texts are read once and go no further; what is shuffled is a digest, the id and the flags of each document.
    """
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failures.values())), F.lit(0))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), bits.alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = rows.withColumn("n", F.lit(1)).withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    if labels is not None:
        of_id = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
        of_id = of_id.agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(f"is_{k}") for k, c in (("good", "quality"), ("toxic", "toxic"))))
        known = rows.where("id is not null").join(of_id, "id", "left").withColumns({k: F.coalesce(f"is_{k}", F.lit(0)) for k in ("good", "toxic")}).drop("is_good", "is_toxic")
        rows = known.unionByName(rows.where("id is null"))
    rows = stage(rows, "flags")
    count = lambda df: df.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in WEIGHTS))
    counts = count(rows)
    if duplicates:
        bit = 1 << len(failures)
        twice = stage(rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1"), "texts")
        total = twice.agg(F.sum("n")).first()[0] or 0
        later = join_spread(rows.where("id is not null").drop("n"), twice, "digest", total).where("id > first").withColumn("n", F.lit(1))
        # a later copy moves from its set of filters to the set with the duplicates' bit
        moved = stage(count(later), "later")
        gone = moved.select("part", "mask", *((-F.col(c)).alias(c) for c in WEIGHTS))
        counts = count(counts.unionByName(gone).unionByName(moved.withColumn("mask", F.col("mask").bitwiseOR(bit)))).where("n > 0")
    counts = stage(counts, "masks")
    unstage(rows)
    return counts


def joint_failures(counts: DataFrame, n_filters: int) -> DataFrame:
    """A row for each part, with J(S) for every set S of filters as arrays ``n``, ``good`` and ``toxic``, at the place S + 1."""
    sets = range(1 << n_filters)
    product = lambda s: f"if(mask & {s} = {s}, 1, 0)"  # noqa: E731  of the flags in s
    sums = [F.expr(f"sum({w} * {product(s)})").alias(f"{w}_{s}") for w in WEIGHTS for s in sets]
    return counts.groupBy("part").agg(*sums).select("part", *(F.array(*(f"{w}_{s}" for s in sets)).alias(w) for w in WEIGHTS))


def _signed(of: str, sets: list[int], sign) -> str:
    return " + ".join(f"{sign(s)} * {of}[{s}]" for s in sets)


def interactions(joint: DataFrame, names: str) -> DataFrame:
    """A row for each part, order of the filters and step: (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    k, every = len(names), range(1 << len(names))
    size = int.bit_count
    array = lambda sums: F.expr(f"array({', '.join(sums)})")
    survive = {w: array(_signed(w, [s for s in every if s & p == s], lambda s: (-1) ** size(s)) for p in every) for w in WEIGHTS}
    holding = [[s for s in every if s >> i & 1] for i in range(k)]
    single = array(f"n[{1 << i}]" for i in range(k))
    alone = array(_signed("n", h, lambda s: (-1) ** (size(s) - 1)) for h in holding)
    shapley = array(_signed("n", h, lambda s: (-1) ** (size(s) + 1) * (factorial(k) // size(s))) for h in holding)
    wide = joint.select("part", *(c.alias(f"left_{w}") for w, c in survive.items()), single.alias("fails"), alone.alias("alone"), shapley.alias("share"))

    steps = []
    for order in permutations(range(k)):
        before = 0
        for step, i in enumerate(order, 1):
            steps.append({"filter_order": "".join(names[j] for j in order), "step": step, "i": i, "before": before, "after": (before := before | 1 << i)})
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, i int, before int, after int>>")
    rows = wide.withColumn("s", F.explode(plan))
    lost = lambda w: F.col(f"left_{w}")[F.col("s.before")] - F.col(f"left_{w}")[F.col("s.after")]
    return rows.select(
        "part", "s.filter_order", "s.step", F.col("left_n")[F.col("s.after")].alias("kept"), lost("n").alias("removed"), (F.col("fails")[F.col("s.i")] - lost("n")).alias("redundant"),
        F.col("alone")[F.col("s.i")].alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.col("share")[F.col("s.i")].alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame | None = None, failures: Mapping[str, Column] | None = None, duplicates: str | None = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """How the filters interact, by part, in every order. failures: conditions under which a document fails, by one-letter name; those of the texts if none are given."""
    failures = text_failures(F.col(text_col)) if failures is None else dict(failures)
    names = "".join(failures) + (duplicates or "")
    if len(names) != len(set(names)) or len(names) != len(failures) + bool(duplicates) or not 1 <= len(names) <= 6:
        raise ValueError("one to six filters with names of one letter each")
    return interactions(joint_failures(flagged(docs, failures, labels, duplicates, id_col, text_col, part_col), len(names)), names)
